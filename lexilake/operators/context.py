"""What is fetched beside a search's hits, and the verdict on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexilake.functions import text as T
from lexilake.operators.retrieval import dense_batch, ranked
from lexilake.session import written


def anchors(hits: DataFrame, index: DataFrame, top: int = 8, k: int = 25) -> DataFrame:
    """query_id, id, rank: up to k anchor chunks of index(id, section, is_anchor) in the sections of each query's first hits."""
    wanted = hits.where(F.col("rank") <= top).select("query_id", "section").distinct()
    few = first_n(index.where("is_anchor").select("id", "section"), k, ["section"])  # no more of a section can be among a query's first k
    return ranked(wanted.join(few, "section").select("query_id", "id"), k, F.col("id"))


def expand_references(references: DataFrame, index: DataFrame, hits: DataFrame, each: int = 5, total: int = 20) -> DataFrame:
    """query_id, id, rank: chunks that references(query_id, source, clause) name, by section or in the text; not those among
    the query's hits. At most `each` a reference and `total` a query.

    Each chunk is read for the distinct clauses of its source. Of these finds the first `each` and as many more as a query
    has hits go on to the queries: no more can be among a reference's first ones.
    """
    references, hits = written(references), written(hits.select("query_id", "id").distinct())
    most = hits.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0
    named = (F.col("section") == F.col("clause")) | F.contains(F.lower("text"), F.lower("clause"))
    place = F.dense_rank().over(Window.partitionBy("source", "clause").orderBy("id"))
    found = index.select("id", "source", "section", "text").join(references.select("source", "clause").distinct(), "source").where(named).select("source", "clause", "id")
    first = found.withColumn("_n", place).where(F.col("_n") <= each + most).drop("_n")
    fresh = first.join(references, ["source", "clause"]).join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti")
    few = first_n(fresh, each, ["query_id", "source", "clause"])
    return ranked(few.select("query_id", "id").distinct(), total, F.col("id"))


def first_n(rows: DataFrame, n: int, keys: list[str]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).where(F.col("_n") <= n).drop("_n")


def critique(hits: DataFrame, queries: DataFrame, threshold: float = 0.5) -> DataFrame:
    """query_id, passed, score, reason for each of queries(query_id, query, regulation) over hits(query_id, rank, score,
    regulation, content): none found, another regulation's texts, scored high enough, or near enough with the question's
    longer words in the first hit."""
    same = (F.col("regulation") == F.col("asked")).cast("int")
    q = queries.select("query_id", "query", F.col("regulation").alias("asked"))
    of = hits.where("rank <= 5").join(q.select("query_id", "asked"), "query_id").groupBy("query_id", "asked")
    seen = of.agg(F.avg(F.coalesce(same, F.lit(0))).alias("aligned"), F.min_by("score", "rank").alias("raw"), F.min_by("content", "rank").alias("content"))
    x = q.join(seen.drop("asked"), "query_id", "left")
    score = T.critique_score(F.coalesce("raw", F.lit(0.0)))
    words = F.filter(T.words(F.lower("query")), lambda w: F.char_length(w) > 3)
    held = F.filter(words, lambda w: F.contains(F.lower("content"), w))
    overlap = F.coalesce(F.try_divide(F.size(held), F.size(words)), F.lit(0.0))
    reason = (
        F.when(F.col("aligned").isNull(), "none")
        .when(F.col("asked").isNotNull() & (F.col("aligned") < 0.2), "mismatch")
        .when((score >= threshold) | ((score > 0.3) & (overlap > 0.6)), "match")
        .otherwise("low")
    )
    return x.select("query_id", (reason == "match").alias("passed"), F.round(score, 6).alias("score"), reason.alias("reason"))


def nearest_centroid(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", label: str = "label") -> DataFrame:
    """key, nearest, similarity: the class whose mean vector is nearest by cosine, the smaller label on ties.

    Labels and keys are whole numbers; few classes are broadcast (see dense_batch).
    """
    parts = vectors.select(label, F.posexplode(column).alias("at", "x")).groupBy(label, "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    means = parts.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("mean"))
    asked = vectors.select(F.col(key).alias("query_id"), F.col(column).alias("vector"))
    best = dense_batch(means.select(F.col(label).alias("id"), F.col("mean").alias("embedding")), asked, 1)
    return best.select(F.col("query_id").alias(key), F.col("id").cast(vectors.schema[label].dataType).alias("nearest"), "similarity")
