from pyspark.sql import functions as F

from lexilake.functions import answers as Q
from lexilake.functions import intent as I
from lexilake.operators import context as C
from lexilake.operators import sections as S


def test_scores_of_empty_and_null_texts(spark):
    rows = spark.createDataFrame([(None, None), ("", "abc words")], "a string, s string")
    got = rows.select(Q.citation_coverage(F.col("a")), Q.groundedness(F.col("a"), F.col("s")), I.intent(F.col("a"))["intent"]).collect()
    assert [tuple(r) for r in got] == [(0.5, 0.0, "out_of_scope")] * 2


def test_sections_drop_what_precedes_and_reset(spark):
    text = "lost\nPART 1 A\nSubpart 1.1 B\n52.236-2 One\nbody\n\n7\nPART 2 C\n52.236-3 Two"
    docs = spark.createDataFrame([(1, "FAR", text), (2, "FAR", None)], "doc_id long, source string, text string")
    got = S.sections(S.lines(docs)).orderBy("section").collect()
    assert [(r.doc_id, r.heading, r.part, r.subpart, r.text) for r in got] == [
        (1, "52.236-2 One", "PART 1 A", "Subpart 1.1 B", "52.236-2 One\nbody"),
        (1, "52.236-3 Two", "PART 2 C", None, "52.236-3 Two"),
    ]


def test_critique_without_hits(spark):
    hits = spark.createDataFrame([(1, 1, 0.4, "FAR", "steel beams here")], "query_id long, rank int, score double, regulation string, content string")
    asked = spark.createDataFrame([(1, "steel beams", "FAR"), (2, "x", None)], "query_id long, query string, regulation string")
    assert {(r.query_id, r.passed, r.reason) for r in C.critique(hits, asked).collect()} == {(1, True, "match"), (2, False, "none")}
