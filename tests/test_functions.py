from pyspark.sql import functions as F

from lexilake.functions import text as T
from lexilake.operators import retrieval as R
from lexilake.operators import upkeep as U


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_clause_references(spark):
    got = one(spark, T.clause_references(F.col("t")), t="FAR 52.236-2, DFARS 252.204 and FAR 9.1; FAR 9.1")
    assert [(r.type, r.clause) for r in got] == [("FAR", "52.236-2"), ("FAR", "9.1"), ("FAR", "9.1"), ("DFARS", "252.204")]


def test_sentences_and_ends(spark):
    assert one(spark, T.sentences(F.col("t")), t="First sentence here. No.\nAnother line of text") == ["First sentence here.", "Another line of text"]
    assert one(spark, T.sentence_aligned_end(F.col("t")), t="ends. ") and not one(spark, T.sentence_aligned_end(F.col("t")), t="ends")


def test_quality_gate(spark):
    assert one(spark, T.passes_quality_gate(F.col("t")), t="the quick brown fox jumps over a lazy dog")
    assert not one(spark, T.passes_quality_gate(F.col("t")), t="--- *** ---")


def test_scores(spark):
    assert [round(one(spark, T.critique_score(F.col("v")), v=v), 4) for v in (8.0, 0.03, 0.5)] == [0.8, 0.6, 0.5]
    assert [round(one(spark, T.answer_score(F.col("v")), v=v), 4) for v in (12.0, 0.001, 0.5)] == [1.0, 0.1, 0.5]
    assert one(spark, T.cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 0.0]) == 0.0


def test_budget_skips_but_goes_on(spark):
    rows = spark.createDataFrame([("q", 1, 5), ("q", 2, 9), ("q", 3, 4)], "g string, i long, n long")
    assert R.greedy_budget(rows, "g", "i", "n", 10).first()[1:] == (9, 2)


def test_budget_builds_no_list_of_a_group(spark):
    rows = spark.range(40_000).selectExpr("if(id % 3 = 0, null, 'hot') g", "40000 - id i", "if(id % 7 = 0, null, id % 5 + 1) n")
    frame = R.greedy_budget(rows, "g", "i", "n", 50_000)
    assert "collect_list" not in frame._jdf.queryExecution().optimizedPlan().toString()
    expected = {}
    for g, _, n in sorted(rows.collect(), key=lambda r: r.i):
        used, taken = expected.get(g, (0, 0))
        expected[g] = (used + n, taken + 1) if n is not None and used + n <= 50_000 else (used, taken)
    assert {r.g: (r.used, r.taken) for r in frame.collect()} == expected
    assert R.greedy_budget(rows.limit(0), "g", "i", "n", 10).count() == 0


def test_namespaces_are_segments(spark):
    t = spark.createDataFrame([("pub-a-1", "pub-a"), ("pub-old-1", "pub-old"), ("public-1", "public")], "id string, namespace string")
    assert {r.namespace for r in t.where(U.in_namespace(F.col("namespace"), "pub")).collect()} == {"pub-a", "pub-old"}
    got = {r.id for r in U.promote(t, "pub-a", "new").collect()}
    assert got == {"pub-a-1", "pub-old-1", "public-1", "new-1"}


def test_many_queries_need_no_broadcast(spark, monkeypatch):
    monkeypatch.setattr(R, "BROADCAST_QUERIES", 1)
    idx = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "id long, embedding array<double>")
    q = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(3)], "query_id long, vector array<double>")
    many = sorted(map(tuple, R.dense_batch(idx, q, 2).collect()))
    monkeypatch.setattr(R, "BROADCAST_QUERIES", 100)
    assert many == sorted(map(tuple, R.dense_batch(idx, q, 2).collect()))
