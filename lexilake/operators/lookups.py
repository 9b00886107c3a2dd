"""Rows by their id, a user's own history, and columns that a table may lack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def section_number(metadata: Column) -> Column:
    """The section's number in a chunk's JSON metadata, else its part; null where both are empty or missing."""
    field = lambda name: F.nullif(F.get_json_object(metadata, f"$.{name}"), F.lit(""))
    return F.coalesce(field("section_number"), field("part"))


def with_optional(chunks: DataFrame) -> DataFrame:
    """chunks(metadata, ...) with chunk_index and source_file, where the table has no such columns: null, and the
    metadata's source or the empty text."""
    lacking = {}
    if "chunk_index" not in chunks.columns:
        lacking["chunk_index"] = F.lit(None).cast("int")
    if "source_file" not in chunks.columns:
        lacking["source_file"] = F.coalesce(F.get_json_object("metadata", "$.source"), F.lit(""))
    return chunks.withColumns(lacking)


def by_id(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """id, content, metadata, chunk_index, source_file of the chunks(id, text, metadata) that ids(id) names."""
    named = chunks.join(ids.select("id").distinct(), "id", "left_semi")
    return with_optional(named).select("id", F.col("text").alias("content"), "metadata", "chunk_index", "source_file")


def owned_history(messages: DataFrame, user: str | int | None = None, most: int = 50) -> DataFrame:
    """The first `most` messages(session_id, user_id, created_at, ...) of each session: a user's and those of nobody, or
    everyone's without a user. Messages of one time stand by the other columns' text."""
    if user is not None:
        messages = messages.where(F.col("user_id").isNull() | (F.col("user_id").cast("string") == str(user)))
    rest = F.to_json(F.struct(*(c for c in messages.columns if c not in ("session_id", "created_at"))))
    n = F.row_number().over(Window.partitionBy("session_id").orderBy("created_at", rest))
    return messages.withColumn("position", n).where(F.col("position") <= most)
