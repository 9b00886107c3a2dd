"""Index upkeep and quality: duplicates, orphans, upserts, promotion, and the reports on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(table: DataFrame, batch: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """The table with the batch's rows in place of those of the same key.

    order: of rows of one key in the batch the last by it stays (one of them, without an order). Rows of the batch
    whose key is null match nothing: all of them are added.
    """
    last = Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last() if order else F.lit(0))
    once = batch.withColumn("_n", F.row_number().over(last)).where((F.col("_n") == 1) | F.col(key).isNull()).drop("_n")
    return table.join(batch.select(key), key, "left_anti").unionByName(once)


def first_of_each(rows: DataFrame, keys: list[Column | str], *order: Column | str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def duplicate_groups(rows: DataFrame, value: Column) -> DataFrame:
    """Groups of equal values and the rows beyond the first of each."""
    g = rows.groupBy(value.alias("v")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return g.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"))


def missing_from(rows: DataFrame, other: DataFrame, key: str, other_key: str) -> DataFrame:
    return rows.join(other.select(F.col(other_key).alias(key)), key, "left_anti")


def in_namespace(column: Column, namespace: str) -> Column:
    """The namespace itself or a segment below it; a prefix that ends within a segment is another namespace."""
    return (column == namespace) | column.startswith(namespace + "-")


def promote(table: DataFrame, source: str, target: str, archive: str | None = None) -> DataFrame:
    """Rows of source copied to target with rewritten id and namespace; the copy is taken first.

    target's old rows go; with archive they stay, under target-archive-<archive>, but for earlier archives, which keep their names.
    """
    move = lambda c, old, new: F.concat(F.lit(new), F.expr(f"substr({c}, {len(old) + 1})"))
    moved = lambda rows, old, new: rows.withColumns({"id": move("id", old, new), "namespace": move("namespace", old, new)})
    of = F.col("namespace")
    copies = moved(table.where(in_namespace(of, source)), source, target)
    replaced = in_namespace(of, target) & ~in_namespace(of, source)
    if archive is not None:
        replaced &= ~in_namespace(of, f"{target}-archive")
    kept = table.where(~F.coalesce(replaced, F.lit(False)))
    if archive is not None:
        kept = kept.unionByName(moved(table.where(replaced), target, f"{target}-archive-{archive}"))
    return upsert(kept, copies)
