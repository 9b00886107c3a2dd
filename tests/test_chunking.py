from pyspark.sql import functions as F

from lexilake.operators import chunking as C
from lexilake.sources import files as S


def words(n, mark="w"):
    return " ".join(f"{mark}{i}" for i in range(n))


def test_wraps_are_undone(spark):
    cases = [
        ("a manufac-\ntured part\u00a0of\nthe work \u2013 x\n(a) first\n(b) second\n\n\n\nnext\r\nline", "FAR", "a manufactured part of the work - x\n(a) first\n(b) second\n\nnext line"),
        ("Stop here.\nnew line\ngoes on\nUpper case", "EM385", "Stop here.\nnew line goes on\nUpper case"),
        (None, "FAR", ""),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "t string, s string")
    assert [r.x for r in df.select(C.unwrapped(F.col("t"), F.col("s")).alias("x")).collect()] == [c[2] for c in cases]


def test_sections_are_cut_within_the_limits():
    assert C.section_chunks("", "FAR") == [] and C.section_chunks(None, None) == []
    short = "52.236-2 Title\n\n" + words(60) + "\n\n" + words(60)
    assert [a for _, a in C.section_chunks(short, "FAR")] == [True, False]
    # beyond 900 tokens: by clause; the anchor first
    long = "52.236-2 Title\n\n" + "\n".join(f"52.236-{k} Clause\n{words(300, f'c{k}x')}" for k in range(3, 7))
    got = C.section_chunks(long, "FAR")
    assert got[0] == ("52.236-2 Title", True) and [x.split()[0] for x, _ in got[1:]] == ["52.236-3", "52.236-4", "52.236-5", "52.236-6"]
    # a section that binds stays whole up to the limit
    assert len(C.section_chunks("Head\n\nYou shall " + words(600), "FAR")) == 2
    # one endless sentence is cut by words, and nothing is lost
    parts = C.paragraph_chunks(words(3000))
    assert max(map(C.size, parts)) <= 900 and " ".join(parts).split() == words(3000).split()
    parts = C.paragraph_chunks("\n\n".join(words(100, f"p{k}x") + "." for k in range(9)))
    assert [C.size(x) for x in parts] == [390, 390, 390]


def test_small_chunks_are_merged_but_no_anchor():
    limits = C.Limits()
    assert C.merged([words(200), words(20)], limits) == [words(200) + "\n\n" + words(20)]
    assert C.merged([words(20), words(200)], limits) == [words(20) + "\n\n" + words(200)]
    assert C.merged(["52.236-2 Title", words(200)], limits) == ["52.236-2 Title", words(200)]
    assert C.merged([words(690), words(20)], limits) == [words(690), words(20)]
    assert C.Limits().overlap == 0 and C.paragraph_chunks(f"{words(300)}\n\n{words(30, 'y')}\n\n{words(300, 'z')}", C.Limits(overlap=50))[1].startswith("y0")


def test_chunks_of_a_table(spark):
    rows = [(1, 1, "FAR", "52.236-2 Title\n\n" + words(200)), (1, 2, "FAR", None), (2, None, "FAR", words(120) + "\n\n" + words(5)), (3, 1, "FAR", "-- * --")]
    df = C.chunk_sections(spark.createDataFrame(rows, "doc_id long, section long, source string, text string"))
    assert sorted((r.doc_id, r.chunk, r.is_anchor) for r in df.collect()) == [(1, 0, True), (1, 1, False), (2, 0, False), (3, 0, True)]
    assert sorted((r.doc_id, r.chunk) for r in C.stored(df).collect()) == [(1, 1), (2, 0)]
    assert C.chunk_sections(df.limit(0).select("doc_id", "section", F.lit("x").alias("source"), "text")).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name in ("FAR_12.pdf", "a/DFARS_x.pdf", "a/EM_385.pdf", "other.txt"):
        (tmp_path / name).write_text("one\n\n two \n")
    found = S.discover(spark, str(tmp_path)).select("filename", S.file_metadata(F.col("filename")).alias("m")).select("filename", "m.*")
    assert sorted(map(tuple, found.collect())) == [("DFARS_x.pdf", "DFARS", "201-253", "regulation"), ("EM_385.pdf", "EM385", "1-1", "regulation"), ("FAR_12.pdf", "FAR", "12", "regulation")]
    assert [r.query for r in S.query_lines(spark, f"{tmp_path}/other.txt").collect()] == ["one", "two"]
    (tmp_path / "cases.json").write_text('[{"id": "a", "query": "q"}, {"id": "b", "query": "r", "require_citation": false, "must_contain_any": ["x"]}]')
    assert [r.require_citation for r in S.query_cases(spark, f"{tmp_path}/cases.json").orderBy("id").collect()] == [True, False]
    t = spark.createDataFrame([(["h", "k"], [["1", None], ["2", "3"]])], "h array<string>, r array<array<string>>")
    assert t.select(S.table_text(F.col("h"), F.col("r")).alias("x")).first().x == "h | k\n1 | \n2 | 3"
    S.write_csv(t.select(F.lit(1).alias("a")), f"{tmp_path}/out")
    assert spark.read.option("header", "true").csv(f"{tmp_path}/out").first().a == "1"
