"""Search over a chunk table (id, source, text, embedding): dense, lexical, fused and boosted, with context building.

Queries are rows: every function takes a table of queries and ranks within each, so one plan serves a batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from lexilake.functions import text as T
from lexilake.operators import lexical as L
from lexilake.session import bounded_batches


def chunks(documents: DataFrame, embeddings: DataFrame) -> DataFrame:
    """The chunk index over the test tables: a document and the vector of the same number."""
    return documents.join(embeddings, documents["doc_id"] == embeddings["vec_id"]).select(F.col("doc_id").alias("id"), "source", "lang", "text", "embedding", "label")


def ranked(hits: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k of each query in the given order, with rank; Spark prunes to k a task before the shuffle's end."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


def dense_search(index: DataFrame, vector: list[float], k: int = 15, source: str | None = None) -> DataFrame:
    """Cosine top k for one query vector."""
    near = index if source is None else index.where(F.col("source") == source)
    v = F.array(*(F.lit(float(x)) for x in vector))
    return near.select("id", F.round(T.cosine(F.col("embedding"), v), 6).alias("similarity")).orderBy(F.desc("similarity"), "id").limit(k)


BROADCAST_QUERIES, SALTS, PRODUCTS = 4096, 64, 1 << 20


def _packed(rows: DataFrame) -> DataFrame:
    """dim, ids, units: the vectors of rows(id, v) of one dimension in an Arrow batch, scaled to unit length, in one row."""

    def pack(batches):
        for b in batches:
            size = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
            for dim in np.unique(size):
                own = b.filter(pa.array(size == dim))
                units = own.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, int(dim))
                length = np.sqrt((units * units).sum(1, keepdims=True))
                with np.errstate(all="ignore"):
                    units = np.nan_to_num(units / length, nan=0.0, posinf=0.0, neginf=0.0)
                yield pa.RecordBatch.from_arrays([pa.array([int(dim)], pa.int32()), pa.array([own.column(0).to_numpy().tobytes()], pa.binary()), pa.array([units.tobytes()], pa.binary())], ["dim", "ids", "units"])

    usable = rows.where(F.col("id").isNotNull() & (F.size("v") > 0)).select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    return usable.mapInArrow(pack, "dim int, ids binary, units binary")


def _best(k: int):
    """The k nearest of each block of vectors to each query of a block, ties to the smaller id; PRODUCTS at once."""

    def pieces(batches):
        for b in batches:
            for i in range(b.num_rows):
                dim, *blocks = (b.column(c)[i] for c in ("dim", "ids", "units", "q_ids", "q_units"))
                ids, units, asked, vectors = (np.frombuffer(x.as_buffer(), t) for x, t in zip(blocks, (np.int64, np.float64) * 2, strict=True))
                units, vectors = units.reshape(-1, dim.as_py()), vectors.reshape(-1, dim.as_py())
                step = max(1, PRODUCTS // len(ids))
                for at in range(0, len(asked), step):
                    yield ids, units, asked[at : at + step], vectors[at : at + step]

    def run(batches):
        for ids, units, asked, vectors in pieces(batches):
            near = np.round(vectors @ units.T, 6)
            out = []
            for s in near:
                rows = np.flatnonzero(s >= np.partition(s, -k)[-k]) if len(s) > k else np.arange(len(s))
                out.append(rows[np.lexsort((ids[rows], -s[rows]))[:k]])
            n = [len(x) for x in out]
            at = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked, n)), pa.array(ids[at]), pa.array(near[np.repeat(np.arange(len(asked)), n), at])], ["query_id", "id", "similarity"])

    return run


def dense_batch(index: DataFrame, queries: DataFrame, k: int = 15) -> DataFrame:
    """query_id, id, similarity, rank for queries(query_id, vector) over index(id, embedding): cosine, 0 where either is zero.

    Vectors are scaled once and packed a block a row; a pair of blocks is one matrix product, of which the k best a
    query are kept. The side of at most BROADCAST_QUERIES rows, if there is one, is broadcast; else blocks of both
    meet by dimension and salt. Null and empty vectors take no part.
    """
    bounded_batches(index.sparkSession)
    rows = index.select("id", F.col("embedding").alias("v"))
    asked = queries.select(F.col("query_id").alias("id"), F.col("vector").alias("v"))
    few = lambda df: df.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES
    known, wanted = _packed(rows), _packed(asked).withColumnsRenamed({"ids": "q_ids", "units": "q_units"})
    if few(asked):
        pairs = known.join(F.broadcast(wanted), "dim")
    elif few(rows):
        pairs = wanted.join(F.broadcast(known), "dim")
    else:
        salted = known.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(SALTS)))
        pairs = salted.join(wanted.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["dim", "salt"])
    found = pairs.select("dim", "ids", "units", "q_ids", "q_units").mapInArrow(_best(k), "query_id long, id long, similarity double")
    return ranked(found, k, F.desc("similarity"), F.col("id"))


def lexical_batch(index: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, id, score, rank: matched term frequencies f, as f / (f + 1), of plain words (see lexical.search)."""
    return L.search(index, queries, k, stems=False)


def reciprocal_rank_fusion(dense: DataFrame, lexical: DataFrame, k: int = 60) -> DataFrame:
    """query_id, id, rrf_score, in_dense, in_lexical from two ranked lists."""
    both = dense.select("query_id", "id", "rank", F.lit(1).alias("d"), F.lit(0).alias("l")).unionByName(lexical.select("query_id", "id", "rank", F.lit(0).alias("d"), F.lit(1).alias("l")))
    return both.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("rrf_score"), F.max("d").alias("in_dense"), F.max("l").alias("in_lexical"))


# Shapes of clause numbers, and titles and texts of chunks that are tables of clauses.
CLAUSE_NUMBERS = r"\b(52\.\d{3}(?:-\d+)?|252\.\d{3}-\d+)\b|\b\d{2}\.\d{3}(?:-\d+)?\b"
META_TITLES = "matrix|appendix|solicitation provisions and contract clauses|key:|matrix notes"
# Questions that ask for the clauses of a project's start, and the clauses meant.
START_QUESTIONS = (
    "mobilization|clauses to review|before project start|before mobilization|pre-mobilization|pre-award|which clauses|what clauses|key clauses|"
    "contract clauses to review"
)
START_CLAUSES = ["52.211", "52.232", "52.236", "52.242", "52.243", "52.249"]


def clause_like(query: Column) -> Column:
    """Whether a query names a clause number, or a clause and some digit."""
    q = F.lower(F.trim(F.coalesce(query, F.lit(""))))
    return q.rlike(CLAUSE_NUMBERS) | (F.contains(q, F.lit("clause")) & q.rlike(r"\d"))


def meta_chunk(title: Column, text: Column) -> Column:
    """Whether a chunk is a table of clauses or notes on one, by its section's title or its first 300 characters."""
    start = F.lower(F.left(F.coalesce(text, F.lit("")), F.lit(300)))
    has = lambda x: F.contains(start, F.lit(x))
    return F.lower(F.coalesce(title, F.lit(""))).rlike(META_TITLES) | (has("matrix notes") & (has("key:") | has("provision or clause")))


def preferred_section(query: Column, section: Column) -> Column:
    """Whether a query asks for the clauses of a project's start and the section is one of them."""
    asks = F.lower(F.coalesce(query, F.lit(""))).rlike(START_QUESTIONS)
    return asks & F.coalesce(section, F.lit("")).rlike("^(?:" + "|".join(p.replace(".", r"\.") for p in START_CLAUSES) + ")")


def boosted(fused: DataFrame, k: int, clause_like: Column | bool = False, preferred: Column | None = None) -> DataFrame:
    """The first k by final_score: preferred rows x 1.4; and on top, of clause-like queries, lexical ones x 1.35, of
    others, those of the dense leg alone x 1.05."""
    clause = clause_like if isinstance(clause_like, Column) else F.lit(clause_like)
    first = F.when(preferred if preferred is not None else F.lit(False), 1.4).otherwise(1.0)
    dense_only = (F.col("in_dense") == 1) & (F.col("in_lexical") == 0)
    second = F.when(clause & (F.col("in_lexical") == 1), 1.35).when(~clause & dense_only, 1.05).otherwise(1.0)
    return ranked(fused.withColumn("final_score", F.round(F.col("rrf_score") * first * second, 9)), k, F.desc("final_score"), F.col("id"))


def hybrid_search(index: DataFrame, queries: DataFrame, k: int = 10, namespace: str | None = None, source: str | None = None, key: str = "id", clause_like: Column | bool = False) -> DataFrame:
    """The first k by both legs, of twice k hits each, over the index's rows of a namespace and a source, if given."""
    near = L.filtered(index, namespace, source, key)
    return boosted(reciprocal_rank_fusion(dense_batch(near, queries, 2 * k), L.search(near, queries, 2 * k)), k, clause_like)


def direct_lookup(index: DataFrame, needle: str, k: int = 10) -> DataFrame:
    """Rows that contain the needle, whatever case, earliest match first."""
    at = F.locate(needle.lower(), F.lower("text"))
    return index.where(at > 0).select("id", at.alias("place")).orderBy("place", "id").limit(k)


def greedy_budget(rows: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """Of each group, in order, rows that still fit the budget; one that doesn't is skipped, not the end.

    A group's rows are read in order by one task, which holds a batch of them at a time.
    """
    kind = rows.schema[group].dataType

    def fold(batches):
        key, used, taken, out = None, 0, 0, []
        for b in batches:
            for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if key is None or key[0] != k:
                    if key:
                        out.append((key[0], used, taken))
                    key, used, taken = (k,), 0, 0
                if n is not None and used + n <= budget:
                    used, taken = used + n, taken + 1
            if len(out) > 1000:
                yield _totals(out, b.schema.field(0))
                out = []
        if key:
            yield _totals([*out, (key[0], used, taken)], b.schema.field(0))

    dealt = rows.select(group, F.col(size).cast("long").alias(size), order).repartition(group).sortWithinPartitions(group, order, size).select(group, size)
    return dealt.mapInArrow(fold, StructType([StructField(group, kind), StructField("used", LongType()), StructField("taken", IntegerType())]))


def _totals(rows: list[tuple], group: pa.Field) -> pa.RecordBatch:
    kinds = (group.type, pa.int64(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], [group.name, "used", "taken"])


def surrounding(index: DataFrame, centres: DataFrame, reach: int = 2) -> DataFrame:
    """Chunks of the same source at most reach ordinals from a centre(source, ordinal): an equi-join per offset."""
    near = centres.select("source", F.explode(F.sequence(F.col("ordinal") - reach, F.col("ordinal") + reach)).alias("ordinal")).distinct()
    return index.join(near, ["source", "ordinal"])
