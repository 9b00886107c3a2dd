"""Queries of stored tables, files to load and composed questions, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexilake.functions import questions as K
from lexilake.operators import stored as W
from lexilake.plans.registry import query
from lexilake.session import shared_folder, table


def _new(spark: SparkSession, key: str) -> W.Stored:
    """An empty table in the shared folder, that goes when the application ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/lexilake-stored-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return W.Stored(spark, path.toString(), key, buckets=8)


@query(
    """SELECT * FROM (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT l_orderkey, first(l_extendedprice ORDER BY l_linenumber DESC, l_extendedprice DESC) FROM lineitem GROUP BY 1)
WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')"""
)
def stored_upserts(spark: SparkSession, d: str) -> DataFrame:
    """Orders, added twice as by a rerun; each line's price in turn as its order's; then the finished orders go."""
    orders, store = table(spark, d, "orders"), _new(spark, "o_orderkey")
    for _ in range(2):
        store.append(orders.select("o_orderkey", "o_totalprice"), "orders")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").alias("o_totalprice"), F.struct("l_linenumber", "l_extendedprice").alias("place"))
    store.upsert(lines, "place", "lines")
    store.remove(orders.where("o_orderstatus = 'F'"), "finished")
    return store.read()


@query(
    """SELECT 'pilot-' || doc_id AS id, 'pilot-' || source AS namespace, 'new' AS kind FROM documents
UNION ALL SELECT 'target-' || doc_id, 'target-' || source, 'new' FROM documents WHERE source IS NOT NULL
UNION ALL SELECT CASE WHEN source IS NULL THEN 'target-' ELSE 'target-archive-1-' END || doc_id, 'target-archive-1-' || source, 'old' FROM documents"""
)
def stored_promotion(spark: SparkSession, d: str) -> DataFrame:
    """A pilot copied over a target that has rows, which are archived."""
    docs, store = table(spark, d, "documents"), _new(spark, "id")
    rows = lambda name, kind: docs.select(F.concat(F.lit(name), "doc_id").alias("id"), F.concat(F.lit(name), "source").alias("namespace"), F.lit(kind).alias("kind"))
    store.append(rows("pilot-", "new"))
    store.append(rows("target-", "old"))
    store.promote("pilot", "target", "1")
    return store.read()


_LOADED = "CASE page_id % 3 WHEN 0 THEN 'rules' WHEN 1 THEN 'rules-far' ELSE 'rulesets' END"


@query(f"SELECT page_id, sha256(html) AS file_hash FROM pages WHERE html IS NULL OR sha256(html) NOT IN (SELECT sha256(html) FROM (SELECT *, {_LOADED} AS namespace FROM pages) WHERE html IS NOT NULL AND (namespace = 'rules' OR starts_with(namespace, 'rules-')))")
def files_to_load(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose bytes the namespace lacks, which has other pages in it and below it."""
    p = table(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("file_hash"), F.expr(_LOADED).alias("namespace"))
    return W.new_files(p.select("page_id", "file_hash"), p, "rules")


@query(r"SELECT item_id, trim(regexp_replace(nfc_normalize(replace(coalesce(text, ''), 'e', 'e' || chr(769))), '\s+', ' ', 'g'), ' ') AS question FROM benchmark")
def composed_questions(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark texts with every e under a combining accent."""
    accented = F.replace(F.col("text"), F.lit("e"), F.lit("e\u0301"))
    return table(spark, d, "benchmark").select("item_id", K.normalised_question(accented).alias("question"))
