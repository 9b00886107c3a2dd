import datetime
import os
import shutil

import pytest
from conftest import SF
from pyspark.sql import functions as F

from lexilake.operators import reports as O
from lexilake.streaming import limits as L
from lexilake.streaming.events import windowed_counts


def test_stream_agrees_with_table_on_closed_windows(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet")
    stream = spark.readStream.schema(batch.schema).parquet(f"{SF}/events.parquet*")
    q = windowed_counts(stream).writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.start, r.event_type): r.n for r in spark.table("closed").collect()}
    want = {(r.start, r.event_type): r.n for r in windowed_counts(batch).collect()}
    last = max(s for s, _ in want)
    assert {k: v for k, v in want.items() if k[0] < last and k in got} == got
    assert len(got) >= len([k for k in want if k[0] < last]) - 5
    assert batch.select(F.count("*")).first()[0] == sum(want.values())


def _decisions(spark, tmp_path, name, make, rows, schema):
    """What a stream decides on rows, which come a file each in the order of their parts, a file a batch."""
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in{i}")
        made = next((tmp_path / f"in{i}").glob("*.parquet"))
        (tmp_path / "in").mkdir(exist_ok=True)
        shutil.copy(made, tmp_path / "in" / f"{i:03d}.parquet")
        os.utime(tmp_path / "in" / f"{i:03d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    got = [(r[0], r[1]) for r in spark.table(name).collect()]
    assert len(got) == len({k for k, _ in got})
    return dict(got), q.lastProgress["stateOperators"][0]["numRowsTotal"]


@pytest.mark.parametrize("which", ["rate", "lock"])
def test_limits_on_a_stream_agree_with_those_on_a_table(spark, tmp_path, which):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts", "user_id", "event_type")
    kept = sorted((tuple(r) for r in events.where("ts is not null").collect()), key=lambda r: (r[1], r[0]))
    day, parts = datetime.timedelta(days=1), []
    for at in range(0, len(kept), -(-len(kept) // 4)):
        parts.append(kept[at : at + -(-len(kept) // 4)])
    for a, b in zip(parts, parts[1:], strict=False):  # rows of the last day come a part late, in any order
        late = [r for r in a if r[1] > a[-1][1] - day / 2]
        a[:] = [r for r in a if r not in late]
        b[:0] = late[::-1]
    beyond = kept[-1][1] + 400 * day
    parts.append([(-1, beyond, None, "view")])
    parts.append([(-2, kept[0][1], kept[0][2], "error"), (-3, beyond + 400 * day, None, "view")])  # one that is too late
    if which == "rate":
        table, stream = O.rate_limited(events, 2, 172_800), lambda s: L.rate_limited(s, 2, 172_800, "1 day")
    else:
        table, stream = O.locked_out(events, most=2, minutes=60 * 24 * 9), lambda s: L.locked_out(s, most=2, minutes=60 * 24 * 9, delay="1 day")
    got, users = _decisions(spark, tmp_path, f"limits_{which}", stream, parts, events.schema)
    want = {r[0]: r[1] for r in table.collect()}
    assert {k: v for k, v in got.items() if k >= 0} == want and set(want.values()) == {True, False}
    assert -2 not in got
    assert users <= 1 if which == "rate" else users < len({r[2] for r in kept}) + 1
