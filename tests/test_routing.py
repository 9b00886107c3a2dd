from pyspark.sql import functions as F

from lexilake.functions import questions as K
from lexilake.functions import routing as V
from lexilake.functions import text as T
from lexilake.operators import search as X
from lexilake.sources import files as S

CELL = "table_id long, cell long, row_from int, row_to int, col_from int, col_to int, text string, header boolean"


def test_table_grid(spark):
    cells = spark.createDataFrame(
        [
            (1, 1, 0, 0, 0, 1, "title", False), (1, 2, 1, 1, 0, 0, " a\n", True), (1, 3, 1, 1, 1, 1, None, None), (1, 4, 2, 2, 0, 0, "x", False),
            (1, 5, 2, 9, 0, 0, "y", False), (1, 6, 3, 3, -3, 9, " ", False), (2, 1, 1, 1, 1, 1, "v", False), (3, 1, 7, 8, 0, 0, "outside", True), (9, 1, 0, 0, 0, 0, "of no table", False),
        ],
        CELL,
    )
    tables = spark.createDataFrame([(1, 5, 2), (2, 2, 2), (3, 2, 2), (4, 0, 0)], "table_id long, num_rows int, num_cols int")
    got = {r.table_id: (r.headers, r.rows) for r in S.table_grid(cells, tables).collect()}
    assert got == {1: (["a", "col_2"], [["x", ""], ["y", ""], ["y", ""]]), 2: (["col_1", "col_2"], [["", "v"]]), 3: ([], []), 4: ([], [])}
    assert S.table_grid(cells.limit(0), tables.limit(0)).count() == 0


def test_formatted_context(spark):
    rows = [(1, 1, "x" * 1201, "FAR", "52", "1.2", 0.5), (1, 2, "y" * 1000, None, None, None, None), (1, 3, None, "FAR", "52", None, 0.25), (2, 1, "z" * 1200, "FAR", "", "", 1.0)]
    rows = spark.createDataFrame(rows, "query_id long, rank int, content string, source string, regulation string, section string, score double")
    got = {r.query_id: (r.n, r.context) for r in X.formatted_context(rows, 400).collect()}
    first = "--- Document 1 ---\nSource: FAR\nRegulation: 52\nSection: 1.2\nScore: 0.500\n\nContent:\n" + "x" * 1200 + "...\n\n"
    third = "--- Document 3 ---\nSource: FAR\nRegulation: 52\nSection: N/A\nScore: 0.250\n\nContent:\n\n\n"
    assert got[1] == (2, first + "\n" + third) and got[2][0] == 1
    assert X.formatted_context(rows, 10).count() == 0


def test_search_terms(spark):
    texts = spark.createDataFrame([("The clauses, THE Clause; don't 52.236",), ("",), (None,)], "t string")
    plain = [r.x for r in texts.select(T.search_terms(F.col("t")).alias("x")).collect()]
    assert plain == [["236", "52", "clause", "clauses"], [], []]
    stemmed = texts.select(T.search_terms(F.col("t"), lambda w: F.regexp_replace(w, "s$", "")).alias("x")).first().x
    assert stemmed == ["236", "52", "clause"]


def test_routes(spark):
    turns = [
        (1, 0, "assistant", "See FAR 52.236-2 and 52.100"), (1, 1, "user", "what does the vendor say"), (1, 2, "assistant", None), (1, 3, "assistant", "Dear Sir,"), (1, 4, "user", "also include this clause"),
        (1, 5, "user", "what does the vendor say"), (2, 0, "user", "what does the vendor say"), (2, 1, "user", None), (2, 2, "user", "add clause into the letter"), (2, 3, "user", "what is a PPI?"),
        (2, 4, "user", "my account and the contract"), (2, 5, "user", "As a project manager with my account and the contract"),
    ]
    t = V.with_history(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).where("role = 'user'").withColumnRenamed("text", "question")
    got = {(r.conv_id, r.turn): (r.next, r.mode, r.clause_reference, r.document_type, r.acronym) for r in V.route(K.classify(t)).collect()}
    assert got[1, 1] == ("data_retrieval", None, "FAR 52.236-2", None, None)
    assert got[1, 4] == ("data_retrieval", None, "FAR 52.236-2", "letter", None)
    assert got[1, 5][:3] == ("clarifier", "clarify", None)  # the citation is five turns back
    assert got[2, 0][0] == "clarifier" and got[2, 1][:2] == ("end", "copilot") and got[2, 2][3] == "letter"
    assert got[2, 3] == ("end", "clarify", None, None, "PPI")
    assert got[2, 4][0] == "clarifier" and got[2, 5][0] == "data_retrieval"
