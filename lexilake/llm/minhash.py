"""Near-duplicate documents by min-max hashing, with every link confirmed on full shingle sets.

Method. One pass over the texts gives each document's set of distinct 5-word shingles and, for each of 64
permutations, both the minimum and the maximum of the permuted set: 128 components from 64 hash evaluations
(Ji et al., "Min-Max Hash for Jaccard Similarity"). Sixteen bands of four minima and sixteen of four maxima
make two sets of similarity 0.75 miss each other with a probability of 5e-6.

Groups. Equal sets are one class from the start (a group-by on a 128-bit digest, each copy then confirmed on the
set of the class's first), so a group of exact copies of any size costs one pair per copy. In a bucket each member is first held against one pivot only, the one it
shares most bands with; members that this connects need nothing more, because only components are asked for.
Members of buckets whose ends are still apart (documents that share a common passage, say, but not three
quarters of their text) are then joined on their rarest shingles: a prefix filter with positional bounds, which
loses no link. Shingles with the same members count as one join key. So nothing is capped.

Scale. Texts move only for documents with a bucket neighbour (a bloom filter of fixed size picks them before the
shuffle). Bucket, class and pivot joins are plain equi-joins, which AQE splits when a key is hot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexilake.llm import wordhash as W
from lexilake.llm.common import Workspace, bounded_batches, released
from lexilake.llm.components import connected_components

SHINGLE, PERMUTATIONS, ROWS = 5, 64, 4
BANDS = 2 * PERMUTATIONS // ROWS
_rng = np.random.Generator(np.random.PCG64(7))
_A = (_rng.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) | np.uint64(1))[:, None]
_B = _rng.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64)[:, None]
_ROW = (_rng.integers(1, 2**63, ROWS, dtype=np.uint64) | np.uint64(1))[None, :]
_BAND = _rng.integers(1, 2**63, BANDS, dtype=np.uint64)
BLOOM_BITS = 1 << 22
COUNTERS = 1 << 18


def shingle_sets(texts: list[bytes | None], k: int = SHINGLE):
    """The sorted distinct shingle hashes of each text."""
    h, at = W.hash_texts(texts, W.SPACED)
    for i in range(len(texts)):
        yield np.unique(W.combine(h[at[i] : at[i + 1]], k))


def min_max(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum of a non-empty set under each permutation."""
    low = np.full(PERMUTATIONS, 2**64 - 1, dtype=np.uint64)
    high = np.zeros(PERMUTATIONS, dtype=np.uint64)
    for a in range(0, len(shingles), 2048):
        v = _A * shingles[None, a : a + 2048] + _B
        np.minimum(low, v.min(axis=1), out=low)
        np.maximum(high, v.max(axis=1), out=high)
    return low, high


def band_keys(shingles: np.ndarray) -> np.ndarray:
    low, high = min_max(shingles)
    rows = np.concatenate([low.reshape(-1, ROWS), high.reshape(-1, ROWS)])
    return W.mix((W.mix(rows) * _ROW).sum(axis=1, dtype=np.uint64) ^ _BAND)


def _signatures(batches):
    for b in batches:
        ids, texts = b.column(0), W.utf8(b.column(1))
        n, keys = np.zeros(len(texts), np.int64), np.zeros((len(texts), BANDS), np.uint64)
        digest = np.zeros((len(texts), 2), np.uint64)
        for i, s in enumerate(shingle_sets(texts)):
            n[i] = len(s)
            if len(s):
                keys[i] = band_keys(s)
                digest[i] = s.sum(dtype=np.uint64), np.bitwise_xor.reduce(W.mix(s * np.uint64(0x9E3779B97F4A7C15)))
        some = n > 0
        yield pa.RecordBatch.from_arrays(
            [
                ids,
                pa.array(n),
                *(pa.array(digest[:, j].view(np.int64), mask=~some) for j in (0, 1)),
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some) * BANDS]).astype(np.int32)), pa.array(keys[some].ravel().view(np.int64))),
            ],
            ["doc_id", "n_shingles", "d0", "d1", "bands"],
        )


def _linked(batches):
    """Pairs of texts whose shingle sets have 100 * intersection >= 75 * union."""
    for b in batches:
        a, c = (list(shingle_sets(W.utf8(b.column(k)))) for k in (2, 3))
        both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, c, strict=True)], dtype=np.int64)
        size = np.array([len(x) + len(y) for x, y in zip(a, c, strict=True)], dtype=np.int64)
        ok = 100 * both >= 75 * (size - both)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok & (both > 0))], ["u", "v", "linked"])


class _Verifier:
    """Confirms pairs (u, v) on the whole texts; keeps the texts of documents that have a candidate."""

    def __init__(self, spark: SparkSession, docs: DataFrame, candidates: DataFrame, work: Workspace):
        bits = candidates.select(F.pmod(F.xxhash64("rep"), F.lit(BLOOM_BITS)).alias("b"))
        words = bits.groupBy(F.expr("cast(b div 32 as int)").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 32 as int))")).alias("m")).toArrow()
        table = np.zeros(BLOOM_BITS // 32, dtype=np.int64)
        table[words["w"].to_numpy()] = words["m"].to_numpy()
        seen = spark.sparkContext.broadcast(table)  # BLOOM_BITS / 4 bytes, whatever the input

        def some(batches):
            for b in batches:
                h = b.column(2).to_numpy()
                yield b.filter(pa.array((seen.value[h // 32] >> (h % 32)) & 1 == 1))

        hashed = docs.where("doc_id is not null").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(BLOOM_BITS)).alias("b"))
        kept = hashed.mapInArrow(released(some), "doc_id long, text string, b long").select("doc_id", "text")
        self.texts = work.save(kept.join(candidates.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"]))
        self.work = work

    def __call__(self, pairs: DataFrame) -> DataFrame:
        a = self.texts.select(F.col("doc_id").alias("u"), F.col("text").alias("a"))
        c = self.texts.select(F.col("doc_id").alias("v"), F.col("text").alias("c"))
        rows = pairs.join(a, "u").join(c, "v").select("u", "v", "a", "c")
        return self.work.save(rows.mapInArrow(released(_linked), "u long, v long, linked boolean"))


def _apart(rows: DataFrame, comp: DataFrame, work: Workspace) -> DataFrame:
    """The rows(key, rep, n_shingles, place) of those keys whose members are not all of one component yet, with it as c."""
    now = rows.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "n_shingles", "place", F.coalesce("component", "rep").alias("c"))
    keys = now.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high")
    return work.save(now.join(keys.select("key"), "key"))


def _pairs(rows: DataFrame) -> DataFrame:
    """Pairs of one key, but of two components, whose sizes and the key's places in both orders allow a link:
    if the key is the first shingle that they share, then they share at most those from there on."""
    one, other = (rows.select("key", F.col("rep").alias(x), F.col("c").alias(f"c{x}"), F.col("n_shingles").alias(f"n{x}"), (F.col("n_shingles") - F.col("place")).alias(f"left{x}")) for x in "uv")
    near = (F.col("cu") != F.col("cv")) & (175 * F.least("leftu", "leftv") >= 75 * (F.col("nu") + F.col("nv"))) & (F.col("u") < F.col("v"))
    return one.join(other, "key").where(near).select("u", "v").distinct()


def _rare_shingles(spark: SparkSession, texts: DataFrame, members: DataFrame, work: Workspace) -> DataFrame:
    """(key, rep, n_shingles, place) with the rarest quarter, and one more, of each member's shingles as keys.

    Two linked sets share at least three quarters of either, so under any one order of all shingles the first
    quarter and one more of both have one in common. Rare ones first keeps passages that many documents share
    out of the keys. The order is by counts in a table of fixed size, then by hash.
    """
    own = texts.join(members.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")

    def counts(batches):
        table = np.zeros(COUNTERS, dtype=np.int64)
        for b in batches:
            for s in shingle_sets(W.utf8(b.column(1))):
                table += np.bincount((s % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS) if len(s) > COUNTERS // 64 else 0
                if len(s) <= COUNTERS // 64:
                    np.add.at(table, (s % np.uint64(COUNTERS)).astype(np.int64), 1)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at])], ["slot", "n"])

    found = own.mapInArrow(released(counts), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(COUNTERS, dtype=np.int64)
    table[found["slot"].to_numpy()] = found["n"].to_numpy()
    order = spark.sparkContext.broadcast(table)  # 8 * COUNTERS bytes, whatever the input

    def keys(batches):
        for b in batches:
            n, out = [], []
            for s in shingle_sets(W.utf8(b.column(1))):
                seen = order.value[(s % np.uint64(COUNTERS)).astype(np.int64)]
                first = len(s) - (3 * len(s) + 3) // 4 + 1 if len(s) else 0
                out.append(s[np.lexsort((s, seen))[:first]])
                n.append(len(s))
            each = np.array([len(x) for x in out], dtype=np.int64)
            rows = np.repeat(np.arange(len(out)), each)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([*out, np.empty(0, np.uint64)]).view(np.int64)),
                    b.column(0).take(pa.array(rows)),
                    pa.array(np.asarray(n, np.int64)[rows]),
                    pa.array(np.concatenate([*map(np.arange, each), np.empty(0, np.int64)]).astype(np.int64)),
                ],
                ["key", "rep", "n_shingles", "place"],
            )

    return work.save(own.mapInArrow(released(keys), "key long, rep long, n_shingles long, place long"))


def _one_key_for_each_list(rows: DataFrame, work: Workspace) -> DataFrame:
    """The rows with one key for all keys of the same members, at a member's first place among them.

    Two texts that share dozens of rare shingles meet once, not dozens of times. No pair is lost: the first place
    is never behind that of the first shingle that two members share.
    """
    lists = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y")).where("n > 1")
    one = lists.groupBy("n", "x", "y").agg(F.min("key").alias("list"))
    keys = work.save(lists.join(one, ["n", "x", "y"]).select("key", "list"))
    return work.save(rows.join(keys, "key").groupBy(F.col("list").alias("key"), "rep", "n_shingles").agg(F.min("place").alias("place")))


def _sign(docs: DataFrame) -> DataFrame:
    return docs.mapInArrow(released(_signatures), "doc_id long, n_shingles long, d0 long, d1 long, bands array<long>")


def _components(narrow: DataFrame, signed: DataFrame, work: Workspace) -> DataFrame:
    """doc_id, component_id of the documents of narrow(doc_id, text) with a set. A doc_id has one text."""
    spark = narrow.sparkSession
    # equal sets are one class, known by its smallest doc_id
    with_set = signed.where("n_shingles > 0 and doc_id is not null")
    classes = with_set.groupBy("d0", "d1").agg(F.min("doc_id").alias("rep"))
    member = work.save(with_set.select("doc_id", "d0", "d1").join(classes, ["d0", "d1"]).select("doc_id", "rep").distinct())
    # equal digests are confirmed on the sets; one that is not so stands for itself
    same = member.where("doc_id <> rep").select(F.col("rep").alias("u"), F.col("doc_id").alias("v"))
    equal = _Verifier(spark, narrow, same.select(F.explode(F.array("u", "v")).alias("rep")).distinct(), work)
    apart = equal(same).where("not linked").select(F.col("v").alias("doc_id")).distinct()
    work.drop(equal.texts)
    if not apart.isEmpty():
        member = work.save(member.join(apart, "doc_id", "left_anti").unionByName(apart.select("doc_id", F.col("doc_id").alias("rep"))))
    reps = with_set.join(member.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    rows = reps.select(F.col("doc_id").alias("rep"), "n_shingles", F.explode("bands").alias("key")).distinct()
    full = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("pivot")).where("n > 1")
    buckets = work.save(rows.join(full.select("key", "pivot"), "key"))

    # first each member against the pivot that it shares most bands with
    star = buckets.where("rep <> pivot").groupBy("rep", "pivot").agg(F.count(F.lit(1)).alias("n"))
    first = star.groupBy("rep").agg(F.max_by("pivot", F.struct(F.col("n"), -F.col("pivot"))).alias("pivot"))
    check = _Verifier(spark, narrow, buckets.select("rep").distinct(), work)
    done = check(first.select(F.col("pivot").alias("u"), F.col("rep").alias("v")))

    comp = work.save(connected_components(done.where("linked").select("u", "v"), work))
    rest = _apart(buckets.select("key", "rep", "n_shingles", F.lit(0).cast("long").alias("place")), comp, work)
    if not rest.isEmpty():
        rare = _rare_shingles(spark, check.texts, rest.select("rep").distinct(), work)
        rest = _apart(_one_key_for_each_list(rare, work), comp, work)
        known = done.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        more = check(_pairs(rest).join(known, ["u", "v"], "left_anti"))
        comp = connected_components(done.unionByName(more).where("linked").select("u", "v"), work)

    found = member.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    return found.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))


def _several_texts(narrow: DataFrame, several: DataFrame, work: Workspace) -> DataFrame:
    """_components() where the ids of several(doc_id) stand for texts of different sets.

    Each text beyond an id's first gets a number that no id has; once its links are known, its component and that of
    the id's first text are one.
    """
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("h")
    theirs = work.save(narrow.join(several, "doc_id", "left_semi").select("doc_id", "text", digest))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("h"))
    ends = narrow.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    free = F.monotonically_increasing_id() + F.lit(ends.high + 1) if ends.high < 1 << 62 else F.lit(ends.low - 1) - F.monotonically_increasing_id()
    named = work.save(theirs.select("doc_id", "h").distinct().withColumn("nth", nth).withColumn("free", free).select("doc_id", "h", F.when(F.col("nth") == 1, F.col("doc_id")).otherwise(F.col("free")).alias("node")))
    texts = narrow.join(several, "doc_id", "left_anti").unionByName(theirs.join(named, ["doc_id", "h"]).select(F.col("node").alias("doc_id"), "text"))
    found = work.save(_components(texts, work.save(_sign(texts)), work))

    others = named.where("node <> doc_id")
    at = lambda node, c: found.select(F.col("doc_id").alias(node), F.col("component_id").alias(c))
    ends = others.join(at("node", "a"), "node", "left").join(at("doc_id", "b"), "doc_id", "left").select(F.coalesce("a", "node").alias("u"), F.coalesce("b", "doc_id").alias("v"))
    joined = work.save(connected_components(ends, work))
    every = found.unionByName(named.select(F.col("node").alias("doc_id")).join(found, "doc_id", "left_anti").select("doc_id", F.col("doc_id").alias("component_id")))
    label = work.save(every.join(joined, every["component_id"] == joined["node"], "left").select("doc_id", F.coalesce("component", "component_id").alias("label")))
    own = label.join(others.select(F.col("node").alias("doc_id")), "doc_id", "left_anti")
    return own.join(own.groupBy("label").agg(F.min("doc_id").alias("component_id")), "label").select("doc_id", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_shingles, component_id, kept.

    A-Z is lower-cased, words are runs without white space. Null and empty texts have an empty set, are linked
    with nothing and kept. Rows without a doc_id take no part: component_id is null, kept is true. Rows that
    repeat a doc_id are one document: what any of its texts is linked with is in its component. Other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    work = Workspace(spark, "minhash")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = work.save(_sign(narrow))
    digest = F.struct("n_shingles", "d0", "d1")  # an empty text beside another one counts, too
    several = signed.where("doc_id is not null").groupBy("doc_id").agg(F.min(digest).alias("a"), F.max(digest).alias("b")).where("a <> b").select("doc_id")
    several = work.save(several)
    found = _components(narrow, signed, work) if several.isEmpty() else _several_texts(narrow, several, work)
    return (
        signed.select("doc_id", "n_shingles")
        .join(found, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that near_duplicates keeps: one document of each component, all other columns as they are."""
    gone = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone.distinct(), docs["doc_id"].cast("long") == F.col("_gone"), "left_anti")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
