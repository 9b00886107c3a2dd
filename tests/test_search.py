import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexilake.functions import questions as K
from lexilake.operators import context as C
from lexilake.operators import retrieval as R
from lexilake.operators import search as X
from lexilake.operators import upkeep as U


def test_context_takes_hits_then_anchors_then_references(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "query_id long, id long, rank int")
    text = spark.createDataFrame([(i, " ".join(["w"] * n)) for i, n in ((1, 10), (2, 20), (3, 5), (4, 4), (5, 1))], "id long, text string")
    got = X.context(rows((7, 1, 1), (7, 2, 2)), rows((7, 1, 1), (7, 3, 2)), rows((7, 3, 1), (7, 4, 2), (7, 5, 3)), text, 20).orderBy("position").collect()
    assert [(r.id, r.kind) for r in got] == [(1, 0), (3, 1), (5, 2)]
    assert X.within_budget(got and spark.createDataFrame([], "query_id long, id long, kind int, rank int, tokens long")).count() == 0


def test_reranking_and_healing(spark):
    hits = spark.createDataFrame([(1, i, i) for i in range(1, 15)], "query_id long, id long, rank int")
    scores = spark.createDataFrame([(1, 3, 9.0), (1, 14, 10.0), (1, 5, 9.0)], "query_id long, id long, score double")
    got = [r.id for r in X.reranked(hits, scores).orderBy("rank").collect()]
    assert got[:3] == [3, 5, 1] and len(got) == 12 and X.reranked(hits).count() == 14
    found = spark.createDataFrame([(1, 0, 1, "F", "s", "same"), (1, 1, 1, "F", "s", "same"), (1, 1, 2, "F", "s", "b"), (1, 0, 2, "F", "s", "c"), (1, 2, 1, "F", "s", "d")], "query_id long, expansion int, rank int, source string, section string, content string")
    assert [r.content for r in X.healed(found).orderBy("position").collect()] == ["same", "c", "b"]


def test_boosts_stack(spark):
    fused = spark.createDataFrame([(1, 1, 0.01, 1, 0), (1, 2, 0.01, 0, 1), (1, 3, 0.01, 1, 1)], "query_id long, id long, rrf_score double, in_dense int, in_lexical int")
    score = lambda **o: [round(r.final_score, 5) for r in R.boosted(fused, 5, **o).orderBy("id").collect()]
    assert score() == [0.0105, 0.01, 0.01]
    assert score(clause_like=True) == [0.01, 0.0135, 0.0135]
    assert score(clause_like=True, preferred=F.lit(True)) == [0.014, 0.0189, 0.0189]
    assert score(preferred=F.lit(True)) == [0.0147, 0.014, 0.014]


def test_upsert_keeps_the_last_of_a_key(spark):
    t, b = (spark.createDataFrame(x, "id int, v string, n int") for x in ([(1, "a", 0), (3, "z", 0)], [(1, "x", 2), (1, "y", 3), (None, "p", 1), (None, "q", 1)]))
    assert sorted(r.v for r in U.upsert(t, b, "id", "n").collect()) == ["p", "q", "y", "z"]


def test_questions(spark):
    cases = [
        ("FAR 52.236-2", "clause_lookup", 1.0, "FAR 52.236-2"), ("DFARS", "regulation_search", 0.8, None), ("compliance requirements", "regulation_search", 0.6, None),
        ("how to bake a cake", "out_of_scope", 0.0, None), ("my apartment has a contact", "out_of_scope", 0.0, None), (" ", "out_of_scope", 0.0, None), (None, "out_of_scope", 0.0, None),
        ("is the document generator down", "out_of_scope", 0.0, None), ("what does the vendor say", "regulation_search", 0.55, None), ("a gas leak here", "regulation_search", 0.55, None),
    ]
    got = K.classify(spark.createDataFrame([c[:1] for c in cases], "question string")).collect()
    assert [(r.question, r.intent, r.confidence, r.clause_reference) for r in got] == cases
    kinds = spark.createDataFrame([("generate a form",), ("an inspection checklist please",), ("draft a letter",), ("hello",)], "q string")
    assert [r.x for r in kinds.select(K.document_type(F.col("q")).alias("x")).collect()] == ["form", "checklist", "letter", None]
    american = K.classify(spark.createDataFrame([("Buy American and steel",)], "question string")).first()
    assert (american.confidence, american.regulation) == (0.6, "FAR")
    near = spark.createDataFrame([("something else", 0.9, 0.1), ("something else", 0.9, 0.95)], "question string, a double, b double")
    assert [(r.intent, r.confidence) for r in K.classify(near, similarity="a", away="b").collect()] == [("regulation_search", 0.9), ("out_of_scope", 0.0)]


def test_clause_places(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("1225-..a \n") for _ in range(rng.randrange(60))) for _ in range(150)] + [None, "", "x" * 50_000 + "12.2" + "y" * 50_000, "ä12.2", "12.2", "12.2 12.2"]
    rows = [(i % 140, "FS"[i % 2], t) for i, t in enumerate(texts)] + [(3, "S", texts[3])]
    clauses = ["12.2", "2-2", "5.-", "1.2-5", "22.22", "999.9"]
    want = {}
    for i, source, t in rows:
        for c in clauses:
            if t and c in t:
                want[source, c, i] = min(want.get((source, c, i), 10**9), t.index(c) + 1)
    index = spark.createDataFrame(rows, "id long, source string, text string")
    refs = spark.createDataFrame([(s, c) for s in "FS" for c in clauses] + [("F", "12.2"), (None, "12.2")], "source string, clause string")
    assert {(r.source, r.clause, r.id): r["at"] for r in X.clause_places(index, refs).collect()} == want and len(want) > 30
    assert X.clause_places(index.limit(0), refs).count() == 0


def test_all_keywords_are_listed(spark):
    asked = spark.createDataFrame([("a bid protest over a hot work permit",)], "question string")
    assert K.classify(asked).first().keywords == ["bid", "protest", "bid protest", "hot work", "hot work permit"]


@pytest.mark.parametrize("name", ["healed_search", "search_regulations", "dispatched_documents"])
def test_texts_are_not_shuffled(spark, name):
    """a few hits go to the texts, whose table is too large for a broadcast here, not texts to the hits."""
    import __spark_entry__

    d = "/root/testdata/sf0.01"
    size = spark.read.parquet(f"{d}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]
    told = spark.sparkContext._jsc.sc().statusStore().executorSummary
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = told("driver").totalShuffleWrite()
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "200000")
    try:
        __spark_entry__.queries()[name](spark, d).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert told("driver").totalShuffleWrite() - before < size / 2


def test_anchors_and_references_of_many_queries(spark):
    """what goes on to the queries is enough where hits take a reference's first chunks, and ids repeat."""
    index = spark.createDataFrame([(i // 2, "s", "x" if i % 3 else "", f"word {i % 2}", i % 5 == 0) for i in range(60)], "id long, source string, section string, text string, is_anchor boolean")
    hits = spark.createDataFrame([(q, i, n) for q in (1, 2) for n, i in enumerate(range(0, 12, q), 1)], "query_id long, id long, rank int")
    refs = spark.createDataFrame([(1, "s", "WORD"), (2, "s", "1"), (2, "s", "x"), (3, "s", "word 1"), (4, "t", "word"), (5, "s", None)], "query_id long, source string, clause string")
    rows = [tuple(r) for r in index.collect()]
    taken = {(r.query_id, r.id) for r in hits.collect()}
    want = set()
    for q in range(1, 6):
        ids = set()
        for _, source, clause in (r for r in map(tuple, refs.collect()) if r[0] == q and r[2]):
            ids |= set(sorted(i for i, s, section, text, _ in rows if s == source and (section == clause or clause.lower() in text) and (q, i) not in taken)[:3])
        want |= {(q, i, n) for n, i in enumerate(sorted(ids)[:4], 1)}
    assert {tuple(r) for r in C.expand_references(refs, index, hits, 3, 4).collect()} == want
    got = C.anchors(hits.withColumn("section", F.when(F.col("query_id") == 1, "x").otherwise("")), index, 8, 3)
    anchor = lambda x: sorted(i for i, _, section, _, a in rows if a and section == x)[:3]
    assert sorted(map(tuple, got.collect())) == sorted((q, i, n) for q, x in ((1, "x"), (2, "")) for n, i in enumerate(anchor(x), 1))


def test_blocks_meet_in_small_parts():
    """a worker holds a part of the products of a block, and one row of blocks at a time."""
    import tracemalloc

    n, asked = 1000, 4000
    rng = np.random.default_rng(1)
    units, vectors = rng.random((n, 8)), rng.random((asked, 8))
    cells = [np.arange(n).tobytes(), units.tobytes(), np.arange(asked).tobytes(), vectors.tobytes()]
    batch = pa.RecordBatch.from_arrays([pa.array([8] * 3, pa.int32()), *(pa.array([c] * 3, pa.binary()) for c in cells)], ["dim", "ids", "units", "q_ids", "q_units"])
    tracemalloc.start()
    found = sum(b.num_rows for b in R._best(2)([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 3 * 2 * asked and peak < 8 * n * asked
