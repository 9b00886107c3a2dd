"""Token counts: the exact histogram of encoded lengths and its suffix sums.

Documents are encoded where they lie; each task hands on one row a length. The histogram has one row a distinct
length, and suffix sums over it answer totals, quantiles and truncated totals for any context limit at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexilake.llm.common import Workspace, bounded_batches, released, tokenizer_file
from lexilake.llm.tokens import Encoder, text_groups

SPAN = 1024


def length_histogram(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """n_tokens, n_docs for each distinct encoded length of docs(text); a null text has length 0."""
    bounded_batches(docs.sparkSession, 512)
    path = tokenizer or tokenizer_file("word_bpe_49k.json")

    def lengths(batches):
        enc, seen = Encoder.of(path), {}
        for b in text_groups(batches, 0):
            for n, d in zip(*(x.tolist() for x in np.unique(enc.lengths(b.column(0)), return_counts=True)), strict=True):
                seen[n] = seen.get(n, 0) + d
        enc.forget()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["n_tokens", "n_docs"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(released(lengths), "n_tokens long, n_docs long").groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length n of a histogram: documents and tokens at or above it (docs_from, tokens_from), the tokens left
    if every document is cut to n (truncated_total), and the share of documents of at most n tokens (quantile).

    Sums go over spans of SPAN lengths, then over the spans' totals, so no task holds the histogram.
    """
    h = histogram.withColumn("span", F.expr(f"n_tokens div {SPAN}"))
    totals = h.groupBy("span").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    later = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    above = totals.select("span", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t"))
    all_ = totals.agg(F.sum("d").alias("all_docs"), F.sum("t").alias("all_tokens"))
    within = Window.partitionBy("span").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    own = h.select("*", F.sum("n_docs").over(within).alias("own_d"), F.sum(F.col("n_docs") * F.col("n_tokens")).over(within).alias("own_t"))
    joined = own.join(above, "span").crossJoin(F.broadcast(all_))  # one row of totals
    docs_from, tokens_from = F.col("own_d") + F.col("d"), F.col("own_t") + F.col("t")
    return joined.select(
        "n_tokens",
        "n_docs",
        docs_from.alias("docs_from"),
        tokens_from.alias("tokens_from"),
        (F.col("all_tokens") - tokens_from + docs_from * F.col("n_tokens")).alias("truncated_total"),
        ((F.col("all_docs") - docs_from + F.col("n_docs")) / F.col("all_docs")).alias("quantile"),
    )


def answers(sums: DataFrame, limits: list[int]) -> DataFrame:
    """limit, docs_over, truncated_total for each context limit, read off suffix_sums at the least length above it; limits
    may fall between lengths. A limit that no document exceeds has no row: nothing is cut there."""
    above = sums.select("*", F.explode(F.array(*(F.lit(int(x)).cast("long") for x in limits))).alias("limit")).where("n_tokens > limit")
    least = above.groupBy("limit").agg(F.min_by(F.struct("n_tokens", "docs_from", "truncated_total"), "n_tokens").alias("m"))
    return least.select("limit", F.col("m.docs_from").alias("docs_over"), (F.col("m.truncated_total") - F.col("m.docs_from") * (F.col("m.n_tokens") - F.col("limit"))).alias("truncated_total"))


def op5_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    histogram = length_histogram(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text"))
    return suffix_sums(Workspace(spark, "lengths").save(histogram))  # written, since the sums read it more than once
