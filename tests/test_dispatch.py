import pytest
from pyspark.sql import functions as F

from lexilake.operators import dispatch as D

ASKED = [
    (1, "clause found", "clause_lookup", "FAR 52.4"), (2, "clause missed", "clause_lookup", "FAR 99.9"), (3, "clause, nothing at all", "clause_lookup", "FAR 99.9"),
    (4, "a search", "regulation_search", None), (5, "a cake", "out_of_scope", None), (6, "no number", "clause_lookup", None), (7, None, None, None),
]
INDEX = [(10, "FAR", "see 52.4 there"), (11, "FAR", "52.4"), (12, "EM385", "52.4"), (13, None, None), (14, "FAR", "")]


@pytest.fixture
def given(spark):
    seen = []

    def search(asked):
        seen.append(sorted(r.query_id for r in asked.select("query_id").collect()))
        hits = [(2, 13, 1, 0.3), (2, 14, 2, 0.2), (4, 12, 1, 0.1), (4, 10, 2, 0.1)]
        return spark.createDataFrame(hits, "query_id long, id long, rank int, score double").join(asked, "query_id", "left_semi")

    return spark.createDataFrame(ASKED, "query_id long, query string, intent string, clause_reference string"), spark.createDataFrame(INDEX, "id long, source string, text string"), search, seen


def test_each_question_takes_one_path(given):
    questions, index, search, seen = given
    got = {(r.query_id, r.position): (r.path, r.id, r.method, r.score, r.content) for r in D.dispatched(questions, index, search).collect()}
    assert got == {
        (1, 1): ("clause", 11, "clause_lookup", 1.0, "**Source: FAR**\n\n52.4\n\n---\n\n**Source: FAR**\n\nsee 52.4 there"),
        (2, 1): ("clause", 13, "clause_fallback", 0.5, "**Source: Unknown**\n\n\n\n---\n\n**Source: FAR**\n\n"),
        (2, 2): ("clause", 13, "hybrid", 0.3, ""), (2, 3): ("clause", 14, "hybrid", 0.2, ""),
        (4, 1): ("regulation", 12, "hybrid", 0.1, "52.4"), (4, 2): ("regulation", 10, "hybrid", 0.1, "see 52.4 there"),
    }
    assert seen == [[2, 3, 4]]
    assert D.dispatched(questions.limit(0), index, search).count() == 0


def test_only_failing_questions_are_searched_again(spark):
    questions = [(1, "the contractor shall", "FAR"), (2, "other", "FAR"), (3, "nothing", None), (4, "weak", None)]
    hits = [(1, i, i, 0.9, "FAR", "x") for i in (1, 2, 3)] + [(2, i, i, 0.9, "EM385", "x") for i in (1, 2, 3)] + [(4, i, i, 0.01, None, None) for i in (1, 2, 3)]
    further = [(q, e, f"{q} {e}") for q in (1, 2, 3, 4) for e in (0, 1, 2)]
    index = [(i, "FAR", None, f"text {i // 2}") for i in range(20)]
    seen = []

    def search(asked):
        rows = {r.query_id: r.query for r in asked.collect()}
        seen.append(sorted(rows.values()))
        return spark.createDataFrame([(k, 4 + k % 2 + n, n + 1) for k in rows for n in range(3)], "query_id long, id long, rank int")

    frames = [
        spark.createDataFrame(x, s)
        for x, s in (
            (questions, "query_id long, query string, regulation string"),
            (hits, "query_id long, id long, rank int, score double, regulation string, content string"),
            (further, "query_id long, expansion int, query string"),
            (index, "id long, source string, section string, text string"),
        )
    ]
    got = sorted((r.query_id, r.origin, r.position, r.id, r.reason) for r in D.searched_twice(*frames, search).collect())
    assert seen == [["2 0", "2 1", "3 0", "3 1", "4 0", "4 1"]]  # a third expansion is not searched, nor is question 1
    assert [x for x in got if x[0] == 1] == [(1, "first", i, i, "match") for i in (1, 2, 3)]
    healed = lambda q, why: [(q, "healed", 1, 4, why), (q, "healed", 2, 6, why)]  # noqa: E731, texts that begin alike once
    assert [x for x in got if x[0] == 2] == healed(2, "mismatch")  # hits of another regulation go
    assert [x for x in got if x[0] == 3] == healed(3, "none")
    assert [x for x in got if x[0] == 4] == [(4, "first", i, i, "low") for i in (1, 2, 3)] + healed(4, "low")


def test_quality_gate(spark):
    rows = [(0.2, "grounded", 0, False), (0.35, "grounded", 0, False), (0.1, "clarify", None, None), (None, None, None, None), (0.1, "copilot", 1, False), (0.1, "copilot", 0, True)]
    df = spark.createDataFrame(rows, "c double, m string, r int, h boolean")
    heals, note = D.quality_gate(F.col("c"), F.col("m"), F.col("r"), F.col("h"), F.lit(2))
    got = [(r.a, r.b.removeprefix("QualityGate: ")) for r in df.select(heals.alias("a"), note.alias("b")).collect()]
    assert got == [
        (True, "confidence=0.20 < 0.35 → healing triggered, added 2 supplemental docs"), (False, "pass (confidence=0.35 >= 0.35)"), (False, "skip (mode=clarify)"),
        (True, "confidence=0.00 < 0.35 → healing triggered, added 2 supplemental docs"), (False, "skip (already retried)"), (False, "skip (already healed at retrieval)"),
    ]
