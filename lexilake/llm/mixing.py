"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, shuffled by a hash, fill blocks of BLOCK_CHARS characters. Block j (from 1) of a source of
weight w is released at slot floor((j - 1) / w) and due at slot ceil(j / w); each slot takes, of the released blocks,
the one of earliest deadline (Baruah et al., "Proportionate Progress"). With weights that sum to one every deadline
is met, so after any number of slots each source is within one block of its share.

Weights are exact: integers in the proportions of the decimals given. The schedule repeats every sum of them slots; it
is computed on the driver for one period, or up to the phase's end where that comes first, so it has at most a slot a
block of BLOCK_CHARS characters. When a source is used up the rest go on with their weights scaled up: at most one
such phase a source. Nothing is dropped: a source of weight zero counts as one in RESOLUTION.
"""

from __future__ import annotations

import heapq
import itertools
import math
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK_CHARS = 65_536
RESOLUTION = 1000
BUCKETS = 1024
BROADCAST_SLOTS = 1 << 17


def whole_weights(weights: dict[str, float], total: int) -> dict[str, int]:
    """Integers of at least 1 that sum to total, near the given proportions (largest remainders)."""
    total = max(total, len(weights))
    if not weights or any(w < 0 for w in weights.values()) or sum(weights.values()) <= 0:
        raise ValueError("weights must be positive in sum and none negative")
    exact = {s: Fraction(str(w)) * total for s, w in weights.items()}
    sum_ = sum(Fraction(str(w)) for w in weights.values())
    out = {s: int(x / sum_) for s, x in exact.items()}
    rest = total - sum(out.values())
    for s in sorted(exact, key=lambda s: (-(exact[s] / sum_ % 1), s))[:rest]:
        out[s] += 1
    for s in [s for s in out if not out[s]]:
        out[max(out, key=lambda s: (out[s], s))] -= 1
        out[s] = 1
    return out


def exact_weights(weights: dict[str, float], resolution: int = RESOLUTION) -> dict[str, int]:
    """Least integers in exactly the given proportions; a zero counts as one in resolution."""
    given = {s: Fraction(str(w)) for s, w in weights.items()}
    sum_ = sum(given.values())
    if not given or min(given.values()) < 0 or not sum_:
        raise ValueError("weights must be positive in sum and none negative")
    given = {s: w or sum_ / resolution for s, w in given.items()}
    scale = math.lcm(*(w.denominator for w in given.values()))
    whole = {s: int(w * scale) for s, w in given.items()}
    common = math.gcd(*whole.values())
    return {s: w // common for s, w in whole.items()}


def pfair_period(weights: dict[str, int], left: dict[str, int] | None = None) -> dict[tuple[str, int], int]:
    """slot of (source, block) for the blocks 0 .. weight - 1 of each source within one period of sum(weights) slots.

    left: blocks that each source has; the schedule stops at the first last one.
    """
    period = sum(weights.values())
    release = lambda s, j: j * period // weights[s]  # noqa: E731  floor(j / w)
    due = lambda s, j: -(-(j + 1) * period // weights[s])  # noqa: E731  ceil((j + 1) / w)
    waiting = [(0, s, 0) for s in sorted(weights)]
    heapq.heapify(waiting)
    ready: list[tuple] = []
    out = {}
    for slot in itertools.count():
        if slot == period:
            break
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (due(s, j), -weights[s], s, j))
        _, _, s, j = heapq.heappop(ready)
        out[s, j] = slot
        if left and j + 1 == left[s]:
            break
        if j + 1 < weights[s]:
            heapq.heappush(waiting, (max(slot + 1, release(s, j + 1)), s, j + 1))
    return out


def phases(blocks: dict[str, int], weights: dict[str, float], resolution: int) -> list[dict]:
    """Until every source is used up: its active sources' weights, each one's first block, and its first slot."""
    out, done, slot = [], dict.fromkeys(blocks, 0), 0
    exact = exact_weights({s: weights[s] for s in blocks}, resolution) if blocks else {}
    while active := {s: exact[s] for s in blocks if done[s] < blocks[s]}:
        common = math.gcd(*active.values())
        whole = {s: w // common for s, w in active.items()}
        left = {s: blocks[s] - done[s] for s in active}
        period, table = sum(whole.values()), pfair_period(whole, left)
        if len(table) == period:
            # slot after the last block of the source that ends first
            length = min((left[s] - 1) // whole[s] * period + table[s, (left[s] - 1) % whole[s]] + 1 for s in active)
        else:
            length = len(table)
        rounds, rest = divmod(length, period)
        out.append({"weights": whole, "period": period, "table": table, "first": {s: done[s] for s in active}, "slot": slot, "length": length})
        taken = {s: rounds * whole[s] for s in active}
        for (s, _), at in table.items():
            taken[s] += at < rest
        for s in active:
            done[s] += taken[s]
        slot += length
    return out


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, block_chars: int = BLOCK_CHARS, resolution: int = RESOLUTION, seed: int = 42) -> DataFrame:
    """docs(source, text, doc_id, ...) with mix_block (from 0 in its source), mix_slot and mix_place (the order within
    a slot) appended. Sorted by mix_slot, mix_place, the sources' characters stand at the target weights.

    weights: by source; a source that it lacks gets the least weight given. Without any, weights are the square roots of
    the sources' characters as whole shares of resolution, so that the schedule's period is no longer than that.
    Rows of one doc_id hash stand in order of their texts' hashes, so text itself is not shuffled for the order. A null source is one source of its own. A null text counts as empty. Documents that begin in a block
    are in it; a longer document takes up the blocks that it reaches into. Every row stays, once, with all its columns but for
    those that bear a result's name.
    """
    spark = docs.sparkSession
    docs = docs.drop("mix_block", "mix_slot", "mix_place")
    own = docs.select(
        F.struct("*").alias("_row"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null")).alias("_s"),
        F.char_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long").alias("_n"),
        F.xxhash64("text").alias("_t"),
        F.xxhash64(F.col("doc_id"), F.lit(seed)).alias("_h"),
    ).withColumn("_b", F.shiftrightunsigned("_h", 54).cast("int"))
    # characters before each bucket of a source, then within it
    sums = own.groupBy("_s", "_b").agg(F.sum("_n").alias("n"))
    before = sums.withColumn("_before", F.coalesce(F.sum("n").over(Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    totals = {r["_s"]: r["n"] for r in sums.groupBy("_s").agg(F.sum("n").alias("n")).collect()}  # a row a source
    if not totals:
        return docs.withColumns({"mix_block": F.lit(0).cast("long"), "mix_slot": F.lit(0).cast("long"), "mix_place": F.lit(0).cast("long")})
    blocks = {s: n // block_chars + 1 for s, n in totals.items()}
    given = {"null" if s is None else "=" + s: w for s, w in (weights or {}).items()}
    if given:
        target = {s: given.get(s, min(given.values())) for s in totals}
    else:
        target = whole_weights({s: max(1.0, n) ** 0.5 for s, n in totals.items()}, resolution)
    plan = phases(blocks, target, resolution)
    starts, slots = [], []
    for k, p in enumerate(plan):
        # beyond a long the weight is never reached
        starts += [(s, k, first, min(p["weights"][s], 2**62), min(p["period"], 2**62), p["slot"]) for s, first in p["first"].items()]
        slots += [(k, s, j, at) for (s, j), at in p["table"].items()]
    # starts has a row a source and phase; slots one a slot of a phase's period, at most one a block
    per_source = {}
    for s, k, first, w, period, slot in starts:
        per_source.setdefault(s, []).append((first, k, w, period, slot))
    ranges = spark.createDataFrame([(s, sorted(v)) for s, v in per_source.items()], "_s string, _r array<struct<first: long, k: int, w: long, period: long, slot: long>>")
    table = spark.createDataFrame(slots, "_k int, _s string, _j long, _at long")

    w = Window.partitionBy("_s", "_b").orderBy("_h", "_t").rowsBetween(Window.unboundedPreceding, -1)
    placed = own.withColumn("_in", F.coalesce(F.sum("_n").over(w), F.lit(0))).join(before.select("_s", "_b", "_before"), ["_s", "_b"])
    placed = placed.withColumn("mix_place", F.col("_before") + F.col("_in")).withColumn("mix_block", F.floor(F.col("mix_place") / block_chars))
    placed = placed.join(F.broadcast(ranges), "_s").withColumn("_p", F.expr("element_at(filter(_r, r -> r.first <= mix_block), -1)"))
    placed = placed.withColumn("_k", F.col("_p.k")).withColumn("_j", F.expr("cast((mix_block - _p.first) % _p.w as long)"))
    # small unless weights have many decimals or sources are many; Spark picks the join by size then
    out = placed.join(F.broadcast(table) if len(slots) <= BROADCAST_SLOTS else table, ["_k", "_s", "_j"])
    slot = F.expr("_p.slot + (mix_block - _p.first) div _p.w * _p.period + _at")
    return out.withColumn("mix_slot", slot).select("_row.*", "mix_block", "mix_slot", "mix_place")


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "source", "mix_block", "mix_slot", "mix_place")
