"""Stems by known pairs; the pruned search against a plain one, and how much it scores."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexilake.functions.stem import IRREGULAR, stem, stem_words
from lexilake.operators import lexical as L
from lexilake.session import table, written

PAIRS = """
consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist consisting consist
consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid
consoling consol consolingly consol consols consol consonant conson consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci
conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir constable constabl constables constabl constance constanc constancy constanc constant constant
knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel
knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive
knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot running run generously generous national nation
happiness happi happily happili hopping hop hoping hope saying say by by boy boy relational relat conditional condit rationalization ration organization organ generate generat
ties tie cries cri gas gas this this kiwis kiwi gaps gap agreed agre feed feed proceed proceed luxuriated luxuri bed bed shed shed controlling control rolling roll valley valley yellow yellow
hopefully hope adjustment adjust replacement replac activate activ effective effect requirements requir contractor contractor safety safeti electrical electr excavation excav clauses claus
policies polici inspections inspect inspected inspect submittals submitt schedules schedul scheduling schedul payments payment terminations termin delays delay delayed delay suspension suspens
""".split()


def test_stems_of_known_words(spark):
    known = dict(zip(PAIRS[::2], PAIRS[1::2], strict=True)) | IRREGULAR
    assert {w: stem(w) for w in known} == known
    words = [*known, None, "", "a", "ää", "éclairs", "123s", "yyy", "s", "ing"]
    got = {r.w: r.s for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", stem_words(F.col("w")).alias("s")).collect()}
    assert got[None] is None and got[""] == "" and got["éclairs"] == "éclair" and all(got[w] == known[w] for w in known)


def plain(docs, asked, k, cut):
    out = set()
    for q, query in asked:
        terms = set(cut(query))
        f = Counter()
        for i, text in docs:
            n = Counter(cut(text))
            f[i] += sum(n[t] for t in terms)
        hits = sorted(((-round(n / (n + 1), 6), i) for i, n in f.items() if n))[:k]
        out |= {(q, i, -s, r) for r, (s, i) in enumerate(hits, 1)}
    return out


@pytest.mark.parametrize("k", [1, 3, 50])
def test_search_is_exact(spark, k):
    import re

    words = [f"term{'abcdefgh'[i % 8]}{'xyz'[i % 3]}s" for i in range(24)] + ["the", "running", "runs"]
    docs = [(i, " ".join(words[(i * j * j + j) % 27] for j in range(i % 40))) for i in range(120)]
    docs += [(1000 + i, "common " * n) for i, n in enumerate((999, 1000, 1001, 2000, 2001, 5000, 5000))] + [(200, None), (201, ""), (7, "again runner running")]
    asked = [(1, "running common"), (2, "the"), (3, None), (4, ""), (5, " ".join(words)), (6, "nowhere"), (7, "termax termbys runs runs")]
    index, queries = spark.createDataFrame([(*d, "x", 1) for d in docs], "id long, text string, term string, f int"), spark.createDataFrame(asked, "query_id long, query string")
    stop = {"the"}
    stems = lambda t: [stem(w) for w in re.findall(r"[^\W_]+", (t or "").lower()) if w not in stop]
    ascii_words = lambda t: [w for w in re.split("[^a-z0-9]+", (t or "").lower()) if len(w) > 1]
    assert {tuple(r) for r in L.search(index, queries, k).collect()} == plain(docs, asked, k, stems)
    assert {tuple(r) for r in L.search(index, queries, k, stems=False).collect()} == plain(docs, asked, k, ascii_words)
    assert L.search(index.limit(0), queries, k).count() == 0


def test_few_documents_are_scored(spark):
    """Candidates are a part of the pairs that share a term, and the share falls as the table grows."""
    share = []
    for sf in ("sf0.01", "sf0.1"):
        d = f"/root/testdata/{sf}"
        texts = table(spark, d, "documents").withColumnRenamed("doc_id", "id")
        asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
        postings, terms = L.stem_postings(texts, asked)
        postings = written(postings)
        all_pairs = postings.join(terms, "term").select("query_id", "id").distinct().count()
        share.append(L.candidates(postings, terms, 10).count() / all_pairs)
    assert share[1] < share[0] < 0.5


def test_positions_and_filters(spark):
    rows = [(1, "The runs of the Runner; running!", "en:a"), (2, None, "en:b"), (3, "", "en"), (4, "the", "english:a")]
    texts = spark.createDataFrame(rows, "id long, text string, key string").withColumn("source", F.lit("s"))
    got = {(r.id, r.term): (r.f, list(r.positions)) for r in L.lexemes(texts).collect()}
    assert got == {(1, "run"): (2, [2, 6]), (1, "runner"): (1, [5])}
    assert [r.id for r in L.filtered(texts, "en", "s", "key").orderBy("id").collect()] == [1, 2]
    assert L.filtered(texts).count() == 4 and L.filtered(texts, source="t").count() == 0


SF = "/root/testdata/sf0.001"


def shuffled(spark, made):
    """Bytes that making and running a table shuffles."""
    told = spark.sparkContext._jsc.sc().statusStore().executorSummary
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = told("driver").totalShuffleWrite()
    made().write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return told("driver").totalShuffleWrite() - before


def test_words_stay_in_their_task(spark):
    """places of words are not shuffled; only rows of an id that repeats, null among them, are grouped."""
    texts = table(spark, SF, "documents").select(F.col("doc_id").alias("id"), "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0]
    assert shuffled(spark, lambda: L.lexemes(texts)) < size / 100
    rows = [(7, "runs far"), (7, "running, runs"), (None, "far"), (None, "the far"), (8, "The far runner"), (9, None)]
    got = L.lexemes(spark.createDataFrame(rows, "id long, text string")).collect()
    want = {(7, "far"): (1, [2]), (7, "run"): (3, [1, 1, 2]), (8, "far"): (1, [2]), (8, "runner"): (1, [3]), (None, "far"): (2, [1, 2])}
    assert {(r.id, r.term): (r.f, list(r.positions)) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("stems", [True, False])
def test_search_moves_no_words(spark, stems):
    """F2 to F5: documents are counted where they are read; with too many queries for that, and with repeated ids, the result is the same."""
    d = "/root/testdata/sf0.01"
    texts, asked = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0]
    assert shuffled(spark, lambda: L.search(texts, asked, stems=stems)) < size / 20
    rows = lambda df: {tuple(r) for r in df.collect()}
    want = rows(L.search(texts, asked, stems=stems, counted=0))
    assert len(want) == 400 and rows(L.search(texts, asked, stems=stems)) == want
    # every third document in two rows
    half = F.floor(F.char_length("text") / 2).cast("int")
    cut = texts.where("id % 3 = 0").select("id", F.concat(F.substr("text", F.lit(1), half), F.lit(" the")).alias("text")).unionByName(texts.where("id % 3 = 0").select("id", F.substr("text", half + 1).alias("text")))
    mixed = texts.where("id % 3 > 0").unionByName(cut)
    assert rows(L.search(mixed, asked, stems=stems)) == rows(L.search(mixed, asked, stems=stems, counted=0))


def test_counts_in_small_parts(spark, monkeypatch):
    """The bounds on what is summed at once change nothing, ids of any kind are ranked as Spark ranks them."""
    docs = [(f"é{i}" if i % 2 else f"z{i}", " ".join(f"w{(i * j) % 7}" for j in range(i))) for i in range(30)] + [(None, "w1"), ("same", "w1 " * 999), ("other", "w1 " * 1000)]
    asked = [(q, " ".join(f"w{(q * j) % 9}" for j in range(q))) for q in range(12)] + [(None, "w1")]
    index, queries = spark.createDataFrame(docs, "id string, text string").repartition(1), spark.createDataFrame(asked, "query_id int, query string")
    want = {tuple(r) for r in L.search(index, queries, 4, counted=0).collect()}
    monkeypatch.setattr(L, "SUMMED", 20)
    assert {tuple(r) for r in L.search(index, queries, 4).collect()} == want and want
