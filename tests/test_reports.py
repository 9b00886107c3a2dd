"""Reports, records and limits on small cases, against plain Python."""

import datetime
import struct
import uuid
from collections import defaultdict

from conftest import SF
from pyspark.sql import functions as F

from lexilake.functions import records as P
from lexilake.operators import reports as O
from lexilake.session import table


def plain_hash(term: str) -> int:
    data, mask, h = term.encode(), 0xFFFFFFFF, 0
    turn = lambda x, r: (x << r | x >> (32 - r)) & mask
    for (k,) in struct.iter_unpack("<I", data[: len(data) // 4 * 4]):
        h = (turn(h ^ (turn(k * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask), 13) * 5 + 0xE6546B64) & mask
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    return struct.unpack("<i", struct.pack("<I", h ^ h >> 16))[0]


def test_term_hash(spark):
    terms = ["", "a", "abc", "abcd", "contract", "über", "日本語テキスト", "ÿ" * 41, "x" * 5000]
    got = spark.createDataFrame([(t,) for t in terms], "t string").select("t", P.term_hash(F.col("t")).alias("h")).collect()
    assert {r.t: r.h for r in got} == {t: plain_hash(t) for t in terms}
    assert len({plain_hash(t) for t in terms}) == len(terms)
    assert spark.createDataFrame([(None,)], "t string").select(P.term_hash(F.col("t"))).first()[0] is None


def histories(events):
    users = defaultdict(list)
    for r in sorted(events.collect(), key=lambda r: (r.ts, r.event_id)):
        users[r.user_id].append(r)
    return users.values()


def test_rate_limited(spark):
    events = table(spark, SF, "events")
    want = {}
    for rows in histories(events):
        hits = []
        for r in rows:
            hits = [t for t in hits if t > r.ts - datetime.timedelta(days=2)]
            want[r.event_id] = len(hits) < 2
            hits += [r.ts] * want[r.event_id]
    got = {r.event_id: r.allowed for r in O.rate_limited(events, 2, 172_800).collect()}
    assert got == want and set(got.values()) == {True, False}


def test_locked_out(spark):
    events = table(spark, SF, "events")
    want = {}
    for rows in histories(events):
        failed, until = 0, None
        for r in rows:
            want[r.event_id] = until is not None and until > r.ts
            if want[r.event_id]:
                continue
            if r.event_type == "signup":
                failed, until = 0, None
            elif r.event_type == "error":
                failed += 1
                until = r.ts + datetime.timedelta(days=9) if failed >= 2 else until
    got = {r.event_id: r.locked for r in O.locked_out(events, most=2, minutes=60 * 24 * 9).collect()}
    assert got == want and set(got.values()) == {True, False}


def test_limits_of_nothing_and_nulls(spark):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string"
    assert O.rate_limited(spark.createDataFrame([], schema)).count() == 0
    at = datetime.datetime(2024, 1, 1)
    rows = [(1, at, None, None), (2, at, None, "error"), (3, None, 1, "error"), (4, at, 1, "error")]
    got = O.rate_limited(spark.createDataFrame(rows, schema), most=1).collect()
    assert {r.event_id: r.allowed for r in got} == {1: True, 2: False, 4: True}


def test_user_uuid(spark):
    same = "6BA7B810-9dad-11d1-80b4-00c04fd430c8"
    names = ["abc", "", "7", "é@x.org", same, "{6ba7b8109dad11d180b400c04fd430c8}", "g" * 32]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", P.user_uuid(F.col("n")).alias("u")).collect()

    def plain(n):
        try:
            uuid.UUID(n)
            return n
        except ValueError:
            return str(uuid.uuid5(uuid.NAMESPACE_DNS, n))

    assert {r.n: r.u for r in got} == {n: plain(n) for n in names}
    assert uuid.UUID(spark.range(1).select(P.user_uuid(F.lit(None).cast("string"))).first()[0]).version == 4


def test_positions(spark):
    rows = spark.createDataFrame([("a", v) for v in (5, 1, 1, 9, 7, None)] + [("b", 3)], "k string, v int")
    got = {r.k: (r.p50, r.p90, r.t50) for r in O.at_index(rows, ["k"], "v", p50=O.rounded(0.5), p90=O.rounded(0.9), t50=O.truncated(0.5)).collect()}
    assert got == {"a": (5, 9, 5), "b": (3, 3, 3)}


def test_records_of_nulls(spark):
    one = spark.sql("select cast(null as array<string>) p, cast(null as string) t, cast(null as boolean) f")
    got = one.select(
        P.path_summary(F.col("p")), P.path_intent(F.col("p")), P.reflected(F.col("f"), F.col("p")), P.category(F.col("t")), P.guard_verdict(F.col("t"))["action"], P.reply_scores(F.col("t")), P.row_numbers(F.col("t")), P.contains_any(F.col("t"), F.col("p"))
    ).first()
    assert tuple(got) == ("unknown", None, False, "other", "allow", [], [], True)


def test_reply_scores(spark):
    replies = ['{"scores": [{"index": 1, "score": 2}, {"index": "2", "score": 3}, 4, {"score": 1}]}', '{"scores": [], "results": [{"index": 0, "score": 0.5}]}', "no json", "{}"]
    got = [r[0] for r in spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, r string").orderBy("i").select(P.reply_scores(F.col("r"))).collect()]
    assert [[tuple(s) for s in g] for g in got] == [[(1, 2.0)], [(0, 0.5)], [], []]
