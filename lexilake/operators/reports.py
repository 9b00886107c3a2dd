"""Reports on chunks, runs and answers, and limits that remember what they let through."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexilake.functions import records as P
from lexilake.functions import text as T
from lexilake.session import written


def at_index(rows: DataFrame, keys: list[str], value: str, **index: Callable[[Column], Column]) -> DataFrame:
    """Values at positions (from 0) of each group's ascending order; index: name = function of the group's row count.

    Null values don't count, and a group of nothing else has no row; null keys are a group. A position beyond a group is null.

    Equal values are counted, the counts sorted by (group, value) over tasks of about equal size, however large one group
    is. A sum a task and group tells which task holds a position; only those tasks' counts are summed up one by one.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = F.struct(F.lit(1).alias("_"), *(F.col(k) for k in keys))  # structs are equal where both hold null
    seen = rows.where(F.col(value).isNotNull()).select(group.alias("_g"), F.col(value).alias("_v")).groupBy("_g", "_v").agg(F.count(F.lit(1)).alias("_c"))
    dealt = written(seen.repartitionByRange(tasks, "_g", "_v").withColumn("_part", F.spark_partition_id()))
    own = Window.partitionBy("_g")
    before = F.coalesce(F.sum("_m").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = dealt.groupBy("_g", "_part").agg(F.sum("_c").alias("_m")).withColumns({"_before": before, "_n": F.sum("_m").over(own)})
    places = F.array(*(F.struct(F.lit(name).alias("name"), at(F.col("_n")).cast("double").alias("place")) for name, at in index.items()))
    wanted = parts.select("_g", "_part", "_before", "_m", F.inline(places)).where((F.col("place") >= F.col("_before")) & (F.col("place") < F.col("_before") + F.col("_m")))
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy("_g", "_part", "name").orderBy("_v"))
    found = dealt.join(wanted, ["_g", "_part"]).withColumn("_upto", upto).where(F.col("_upto") > F.col("place"))
    values = found.groupBy("_g").agg(*(F.min(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in index))
    return parts.select("_g").distinct().join(values, "_g", "left").select(*(F.col("_g").getField(k).alias(k) for k in keys), *index)


def nearest_rank(share: float) -> Callable[[Column], Column]:
    """Position of the first value that so large a share of the rows doesn't exceed."""
    return lambda n: F.greatest(F.ceil(n * F.lit(share)) - 1, F.lit(0))


def between(rows: DataFrame, keys: list[str], value: str, **shares: float) -> DataFrame:
    """Percentiles of each group by shares, on the line between the two values at either side of share * (n - 1)."""
    low = {f"{name}_low": lambda n, q=q: F.floor((n - 1) * F.lit(q)) for name, q in shares.items()}
    high = {f"{name}_high": lambda n, q=q: F.ceil((n - 1) * F.lit(q)) for name, q in shares.items()}
    n = rows.where(F.col(value).isNotNull()).groupBy(F.struct(F.lit(1).alias("_"), *(F.col(k) for k in keys)).alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
    at = at_index(rows, keys, value, **low, **high).withColumn("_g", F.struct(F.lit(1).alias("_"), *(F.col(k) for k in keys))).join(n, "_g")
    part = lambda q: (F.col("_n") - 1) * F.lit(q) - F.floor((F.col("_n") - 1) * F.lit(q))
    line = lambda name, q: F.col(f"{name}_low") * (1 - part(q)) + F.col(f"{name}_high") * part(q)
    return at.select(*keys, *(line(name, q).alias(name) for name, q in shares.items()))


def rounded(share: float) -> Callable[[Column], Column]:
    """Position share * (n - 1), halves to the even one."""
    return lambda n: F.rint(F.lit(share) * (n - 1))


def truncated(share: float) -> Callable[[Column], Column]:
    return lambda n: F.floor(n * F.lit(share))


def document_report(chunks: DataFrame, tiny: int = 80) -> DataFrame:
    """Per doc_id of chunks(doc_id, text): chunks, shares of tiny ones and of tiny anchors, sizes, and whether over 20 % are tiny."""
    sized = chunks.where(F.coalesce("text", F.lit("")) != "").select("doc_id", T.estimated_tokens(F.col("text")).alias("tokens"), T.is_anchor(F.col("text")).alias("anchor"))
    small, n = F.col("tokens") < tiny, F.count(F.lit(1))
    share = lambda test: F.round(F.count_if(test) / n * 100, 2)
    sums = sized.groupBy("doc_id").agg(
        n.alias("chunks"), share(small).alias("tiny_pct"), share(small & F.col("anchor")).alias("anchor_tiny_pct"), F.round(F.avg("tokens"), 1).alias("avg_tok"), F.max("tokens").alias("max_tok")
    )
    middle = at_index(sized, ["doc_id"], "tokens", p50_tok=rounded(0.5), p90_tok=rounded(0.9))
    return sums.join(middle, "doc_id").withColumn("high_tiny", F.col("tiny_pct") > 20)


def corpus_report(documents: DataFrame) -> DataFrame:
    """One row over a document report: documents, chunks, share of tiny chunks weighted by chunks, documents with over 20 %."""
    weighted = F.round(F.coalesce(F.try_divide(F.sum(F.col("chunks") * F.col("tiny_pct")), F.sum("chunks")), F.lit(0.0)), 2)
    return documents.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("total_chunks"), weighted.alias("weighted_tiny_pct"), F.count_if("high_tiny").alias("high_tiny_docs"))


def worst(rows: DataFrame, score: str, key: str, text: str, n: int = 10) -> DataFrame:
    """The n rows of the lowest score, ties to the smaller key, with a preview."""
    return rows.orderBy(F.col(score).asc_nulls_last(), key).limit(n).select(key, score, P.preview(F.col(text), 120, "...").alias("preview"))


def sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows by the order of a seeded digest of their key: the same at each run, whatever the partitions."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def end_to_end_gate(cases: DataFrame, passed: float = 0.85, fallback: float = 0.20, citation: float = 0.85, latency: float = 12.0) -> DataFrame:
    """One row over cases(passed, fallback, has_citation, seconds): rates, mean latency, and whether all hold."""
    rate = lambda c: F.round(F.avg(F.col(c).cast("int")), 6)
    sums = cases.agg(rate("passed").alias("pass_rate"), rate("fallback").alias("fallback_rate"), rate("has_citation").alias("citation_rate"), F.round(F.avg("seconds"), 6).alias("avg_latency"))
    holds = (F.col("pass_rate") >= passed) & (F.col("fallback_rate") <= fallback) & (F.col("citation_rate") >= citation) & (F.col("avg_latency") <= latency)
    return sums.withColumn("holds", F.coalesce(holds, F.lit(False)))


def latency_summary(rows: DataFrame, keys: list[str], seconds: str) -> DataFrame:
    """Mean, least and most seconds, and how many took under 4, under 8, and 8 or more."""
    s = F.col(seconds)
    return rows.groupBy(*keys).agg(
        F.round(F.avg(s), 2).alias("mean_s"), F.min(s).alias("min_s"), F.max(s).alias("max_s"), F.count_if(s < 4).alias("fast"), F.count_if((s >= 4) & (s < 8)).alias("fair"), F.count_if(s >= 8).alias("slow")
    )


def usage_summary(log: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """One row over the queries of log(created_at, was_cached, intent, reflection_triggered, low_confidence, error_count,
    quality_score, citation_coverage, groundedness_score, latency_ms) in the hours before as_of: counts, means, percentiles.

    Nulls are in no filtered count and no mean. Without a query in that time counts are 0, the rest null.
    """
    recent = log.where(F.col("created_at") > as_of - F.make_interval(hours=F.lit(hours)))
    intent = lambda name: F.count_if(F.col("intent") == name)
    mean = lambda c, places: F.round(F.avg(F.col(c)), places)
    sums = recent.agg(
        F.count(F.lit(1)).alias("total_queries"), F.count_if("was_cached").alias("cached_queries"), intent("regulation_search").alias("regulation_searches"), intent("clause_lookup").alias("clause_lookups"),
        intent("out_of_scope").alias("out_of_scope"), F.count_if("reflection_triggered").alias("reflection_count"), F.count_if("low_confidence").alias("low_confidence_count"),
        F.count_if(F.col("error_count") > 0).alias("error_queries"), mean("quality_score", 4).alias("avg_quality_score"), mean("citation_coverage", 4).alias("avg_citation_coverage"),
        mean("groundedness_score", 4).alias("avg_groundedness"), mean("latency_ms", 0).alias("avg_latency_ms"),
    )
    times = between(recent, [], "latency_ms", p50_latency_ms=0.5, p95_latency_ms=0.95, p99_latency_ms=0.99)
    times = times.select(*(F.round(c, 0).alias(c) for c in times.columns), F.lit(1).alias("_one"))
    return sums.withColumns({"_one": F.lit(1), "period_hours": F.lit(hours)}).join(times, "_one", "left").drop("_one")


def evidence_summary(hits: DataFrame, key: str, rank: str, score: str) -> DataFrame:
    """Per key: hits, the first one's score and the mean, on the scale of answers."""
    s = T.answer_score(F.coalesce(score, F.lit(0.0)))
    return hits.groupBy(key).agg(F.count(F.lit(1)).alias("doc_count"), F.round(F.min_by(s, rank), 6).alias("top_norm"), F.round(F.avg(s), 6).alias("avg_norm"))


Decide = Callable[[dict, int, str], object]


def limiter(most: int, seconds: int) -> Decide:
    """Decision on a hit: True where fewer than `most` allowed hits lie within the seconds before; those are the state."""
    span = seconds * 1_000_000

    def decide(state: dict, at: int, kind: str) -> bool:
        hits = state.setdefault("hits", deque())
        while hits and hits[0] <= at - span:
            hits.popleft()
        if len(hits) >= most:
            return False
        hits.append(at)
        return True

    return decide


def lockout(failure: str, success: str, most: int, minutes: int) -> Decide:
    """Decision on an event: True while locked. The state is the count of failures and the end of a lock."""
    span = minutes * 60_000_000

    def decide(state: dict, at: int, kind: str) -> bool:
        if at < state.get("until", at):
            return True
        if kind == success:
            state.clear()
        elif kind == failure:
            state["failed"] = state.get("failed", 0) + 1
            if state["failed"] >= most:
                state["until"] = at + span
        return False

    return decide


def by_user(events: DataFrame) -> DataFrame:
    """event_id, _user, _at (microseconds), _kind of the events that have a time; those without a user are one user's."""
    known = F.coalesce(F.col("user_id").cast("string"), F.lit("null:"))
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.where("ts is not null").select("event_id", known.alias("_user"), at.alias("_at"), F.coalesce("event_type", F.lit("")).alias("_kind"))


def _folded(events: DataFrame, schema: str, decide: Decide) -> DataFrame:
    """Each user's events in order through decide(state, microseconds, type), a batch in memory at a time.

    All of a user's events pass one task, since each decision rests on those before; only the user's state is kept.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, state = None, {}
        for b in batches:
            out = []
            for u, at, kind in zip(b["_user"], b["_at"], b["_kind"], strict=True):
                if u != user:
                    user, state = u, {}
                out.append(decide(state, at, kind))
            yield pd.DataFrame({"event_id": b["event_id"], schema.split()[0]: out})

    return by_user(events).repartition("_user").sortWithinPartitions("_user", "_at", "event_id").mapInPandas(fold, f"event_id long, {schema}")


def rate_limited(events: DataFrame, most: int = 10, seconds: int = 60) -> DataFrame:
    """event_id, allowed: fewer than `most` allowed hits of the user lie within the seconds before; rejected hits don't count.

    Events without a time are left out; those without a user count as one user's.
    """
    return _folded(events, "allowed boolean", limiter(most, seconds))


def locked_out(events: DataFrame, failure: str = "error", success: str = "signup", most: int = 5, minutes: int = 15) -> DataFrame:
    """event_id, locked: whether the user was locked out when the event came.

    A failure adds one to the user's count; from `most` on it locks for so many minutes. Events while locked change nothing;
    a success sets the count to 0, the end of a lock doesn't.
    """
    return _folded(events, "locked boolean", lockout(failure, success, most, minutes))
