import datetime
import unicodedata

import pytest
from pyspark.sql import functions as F

from lexilake.functions import questions as K
from lexilake.operators import stored as W

SCHEMA = "id long, v string"


@pytest.fixture
def store(spark, tmp_path):
    made = W.Stored(spark, f"file://{tmp_path}/table", buckets=4)
    made.append(spark.createDataFrame([(i, f"old{i}") for i in range(20)] + [(None, "nobody")], SCHEMA), "first")
    return made


def held(store, version=None):
    return sorted((r.id if r.id is not None else -1, r.v) for r in store.read(version).collect())


def test_upsert_agrees_with_a_dictionary(spark, store):
    rows = [(3, "a", 1), (3, "b", 2), (3, "z", None), (25, "c", 1), (None, "x", 1), (None, "x", 2)]
    assert store.upsert(spark.createDataFrame(rows, SCHEMA + ", n int"), "n", "second")
    want = {i: f"old{i}" for i in range(20)} | {3: "b", 25: "c"}
    assert held(store) == sorted([*want.items(), (-1, "nobody"), (-1, "x"), (-1, "x")])
    assert held(store, 1) == sorted([*((i, f"old{i}") for i in range(20)), (-1, "nobody")])
    store.upsert(spark.createDataFrame([(3, "same"), (3, "same")], SCHEMA))
    assert dict(held(store))[3] == "same" and len(held(store)) == 24


def test_a_batch_counts_once(spark, store):
    before = held(store)
    assert not store.append(spark.createDataFrame([(1, "again")], SCHEMA), "first")
    assert held(store) == before and store.versions() == [1]


@pytest.mark.parametrize("step", ["_write", "_commit"])
def test_a_lost_run_changes_nothing_and_its_rerun_does_it(spark, store, monkeypatch, step):
    before, real, calls = held(store), getattr(W.Stored, step), []

    def lost(self, *args):
        calls.append(1)
        if step == "_commit" or len(calls) == 2:  # between the batch's files and the rewritten ones, or before the manifest
            raise RuntimeError("lost")
        return real(self, *args)

    batch = spark.createDataFrame([(3, "new"), (None, "new")], SCHEMA)
    monkeypatch.setattr(W.Stored, step, lost)
    with pytest.raises(RuntimeError):
        store.upsert(batch, batch_id="b")
    monkeypatch.undo()
    assert held(store) == before and store.versions() == [1]
    assert store.upsert(batch, batch_id="b") and not store.upsert(batch, batch_id="b")
    assert held(store) == sorted([r for r in before if r[0] != 3] + [(3, "new"), (-1, "new")])


def test_only_touched_buckets_are_rewritten(spark, store):
    old = store._manifest()["parts"]
    store.upsert(spark.createDataFrame([(3, "new")], SCHEMA))
    new = store._manifest()["parts"]
    assert len(old) > 1 and sum(old[b] != new[b] for b in old) == 1


def test_two_writers_of_one_version(spark, store, monkeypatch):
    real = W.Stored._write

    def meanwhile(self, rows, old):
        monkeypatch.undo()
        W.Stored(spark, self.path).append(spark.createDataFrame([(99, "other")], SCHEMA))
        return real(self, rows, old)

    monkeypatch.setattr(W.Stored, "_write", meanwhile)
    with pytest.raises(W.Conflict):
        store.append(spark.createDataFrame([(98, "mine")], SCHEMA))
    assert {99} == {i for i, _ in held(store) if i > 20}


def test_remove_and_rewrite(spark, store):
    store.remove(spark.createDataFrame([(1,), (1,), (2,), (77,), (None,)], "id int"))
    assert [i for i, _ in held(store)] == [-1, 0, *range(3, 20)]
    before = store.versions()
    store.remove(spark.createDataFrame([], "id long"))
    assert len(held(store)) == 19 and len(store.versions()) == len(before) + 1
    store.rewrite(lambda rows: rows.where("false"))
    assert held(store) == [] and store.read().columns == ["id", "v"]
    store.upsert(spark.createDataFrame([(1, "back")], SCHEMA))
    assert held(store) == [(1, "back")]


def test_nothing_stored_and_empty_batches(spark, tmp_path):
    made = W.Stored(spark, f"file://{tmp_path}/empty")
    with pytest.raises(ValueError):
        made.read()
    made.upsert(spark.createDataFrame([], SCHEMA))
    assert made.read().count() == 0 and made.read().columns == ["id", "v"]
    with pytest.raises(ValueError):
        made.append(spark.createDataFrame([(1, 2)], "id long, _bucket int"))


def test_promotion_archives_but_keeps_earlier_archives(spark, tmp_path):
    made = W.Stored(spark, f"file://{tmp_path}/promoted", buckets=2)
    made.append(spark.createDataFrame([("pilot-1", "pilot", "n"), ("target-1", "target", "o"), ("target-2", "target-a", "o"), ("target-archive-0-9", "target-archive-0", "p"), ("targets-1", "targets", "q"), ("x", None, "r")], "id string, namespace string, v string"))
    made.promote("pilot", "target", "1")
    assert sorted((r.id, r.namespace, r.v) for r in made.read().collect() if r.namespace) == [
        ("pilot-1", "pilot", "n"), ("target-1", "target", "n"), ("target-archive-0-9", "target-archive-0", "p"), ("target-archive-1-1", "target-archive-1", "o"),
        ("target-archive-1-2", "target-archive-1-a", "o"), ("targets-1", "targets", "q"),
    ]
    made.promote("pilot", "target")
    assert sorted(r.id for r in made.read().collect()) == ["pilot-1", "target-1", "targets-1", "x"]


def test_new_files_of_a_namespace(spark):
    loaded = spark.createDataFrame([("a", "regs"), ("b", "regs-far"), ("c", "regsx"), (None, "regs")], "file_hash string, namespace string")
    files = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "n int, file_hash string")
    assert sorted(r.n for r in W.new_files(files, loaded, "regs").collect()) == [3, 4]


def test_answers_without_documents_are_not_cached(spark, tmp_path):
    now = F.lit(datetime.datetime(2024, 1, 1)).cast("timestamp")
    answers = spark.createDataFrame([("a", ["d"]), ("b", []), ("c", None)], "cache_key string, documents array<string>")
    cache = W.Stored(spark, f"file://{tmp_path}/cache", "cache_key", 2)
    for _ in range(2):
        cache.upsert(W.cacheable(answers, now))
    assert [(r.cache_key, r.expires_at.hour) for r in cache.read().collect()] == [("a", 4)]


def test_composed_questions(spark):
    texts = ["plain  text\n", "cafe\u0301", "caf\u00e9", "\u1112\u1161\u11ab", "a\u00a0\u2003b\u0085", "\u212b", "q\u0307\u0323", "", None]
    got = [r.q for r in spark.createDataFrame([(t,) for t in texts], "t string").select(K.normalised_question(F.col("t")).alias("q")).collect()]
    assert got == [" ".join(unicodedata.normalize("NFC", t or "").split()) for t in texts]
