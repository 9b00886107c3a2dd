import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexilake.operators import reports as O


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    hot = [("hot", rng.choice([rng.randrange(40), rng.randrange(10_000)])) for _ in range(3_000)]
    return hot + [(rng.choice(["a", "b", None]), rng.randrange(9)) for _ in range(200)] + [("one", 5), ("void", None), ("a", None), (None, None)]


def groups(rows):
    out = {}
    for k, v in rows:
        if v is not None:
            out.setdefault(k, []).append(v)
    return {k: sorted(v) for k, v in out.items()}


def test_positions_of_hot_and_null_groups(spark, rows):
    df = spark.createDataFrame(rows, "k string, v int")
    got = {r.k: (r.low, r.mid, r.high, r.beyond) for r in O.at_index(df, ["k"], "v", low=lambda n: F.lit(0), mid=O.rounded(0.5), high=lambda n: n - 1, beyond=O.truncated(1.0)).collect()}
    assert got == {k: (v[0], v[int(np.rint(0.5 * (len(v) - 1)))], v[-1], None) for k, v in groups(rows).items()}
    ranks = {r.k: r.p for r in O.at_index(df, ["k"], "v", p=O.nearest_rank(0.9)).collect()}
    assert ranks == {k: v[max(0, int(np.ceil(len(v) * 0.9)) - 1)] for k, v in groups(rows).items()}


def test_percentiles_between_values(spark, rows):
    df = spark.createDataFrame(rows, "k string, v int")
    got = {r.k: (r.p50, r.p99) for r in O.between(df, ["k"], "v", p50=0.5, p99=0.99).collect()}
    want = {k: tuple(np.percentile(v, [50, 99])) for k, v in groups(rows).items()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    whole = O.between(df, [], "v", p50=0.5).first()
    assert whole.p50 == np.median([v for _, v in rows if v is not None])
    assert O.between(df.limit(0), [], "v", p50=0.5).count() == O.at_index(df.where("v is null"), ["k"], "v", p=O.rounded(0.5)).count() == 0


def test_usage_without_queries(spark):
    log = "created_at timestamp, was_cached boolean, intent string, reflection_triggered boolean, low_confidence boolean, error_count int, quality_score double, citation_coverage double, groundedness_score double, latency_ms int"
    got = O.usage_summary(spark.createDataFrame([], log), F.lit("2024-01-01").cast("timestamp")).first()
    assert got.total_queries == got.cached_queries == got.error_queries == 0 and got.p95_latency_ms is got.avg_latency_ms is None and got.period_hours == 24
