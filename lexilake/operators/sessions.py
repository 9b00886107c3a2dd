"""Application tables: analytics, feedback, chat threads, response cache, rate limit and lockout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def threads(turns: DataFrame, preview: int = 80) -> DataFrame:
    """conv_id, last turn, and the first user message cut to a preview (null if blank)."""
    first = F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn")))
    shown = F.trim(F.left(F.coalesce("first", F.lit("")), F.lit(preview)))
    return turns.groupBy("conv_id").agg(F.max("turn").alias("last_turn"), first.alias("first")).select("conv_id", "last_turn", F.nullif(shown, F.lit("")).alias("preview"))


def window_counts(events: DataFrame, seconds: int = 60) -> DataFrame:
    """Hits of the user within the window that ends with each event."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy(at).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return events.select("event_id", "user_id", F.count(F.lit(1)).over(w).alias("hits"))


def failures_since_success(events: DataFrame, failure: str = "error", success: str = "signup", limit: int = 5) -> DataFrame:
    """event_id, failures (failures of the user since their last success), locked (limit reached)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    run = events.withColumn("run", F.sum((F.col("event_type") == success).cast("int")).over(w))
    v = Window.partitionBy("user_id", "run").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    count = F.sum((F.col("event_type") == failure).cast("int")).over(v)
    return run.select("event_id", count.alias("failures"), (count >= limit).alias("locked"))
