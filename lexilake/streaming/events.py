"""Event-time aggregation of an event stream, and the same over a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events by type and window. On a stream, windows close once the watermark passes them; rows later than that are left out."""
    at = events.withColumn("at", F.col("ts").cast("timestamp"))
    if at.isStreaming:
        at = at.withWatermark("at", delay)
    return at.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
