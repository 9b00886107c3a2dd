"""Connected components of an edge table by alternating large-star and small-star rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexilake.llm.common import Workspace


def connected_components(edges: DataFrame, work: Workspace, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(u, v); component is the least node reachable.

    Each round links a node's neighbours to the least of them, first the larger ones, then the smaller ones
    (Kiryati et al., "Connected Components in MapReduce and Beyond"); the number of rounds grows with the
    logarithm of a path's length, and no step collects a neighbourhood. Null nodes and loops take no part.
    """
    now = work.save(
        edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    mark = _mark(now)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        after = work.save(small.where("u <> v").distinct())
        got = _mark(after)
        work.drop(now)
        now = after
        if got == mark:
            break
        mark = got
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
    return row.n, row.x
