"""Nulls, empty texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import zlib

import numpy as np
import pytest

from lexilake.llm import ann, chat, decontaminate, lengths, minhash, mixing, ngram, pages, tokens, toxicity
from lexilake.llm.common import tokenizer_file

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, row int, kept string, mix_slot int, n_words string, contaminated string"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, "x", 1, "x", 5, "x", "x") for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    same = "one two three four five six seven eight nine ten eleven twelve"
    return docs(spark, [(1, None, "a"), (2, "", None), (3, same, "a"), (4, same, "a"), (4, same, "a"), (5, LONG, "b"), (6, " \n", "b"), (7, "A B", None), (None, same, "c")])


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, []).limit(0)


def test_near_duplicates(odd, none):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(odd).collect()}
    assert got == {(1, 0, 1, True), (2, 0, 2, True), (3, 8, 3, True), (4, 8, 3, False), (5, 977, 5, True), (6, 0, 6, True), (7, 1, 7, True), (None, 8, None, True)}
    assert minhash.near_duplicates(odd).count() == 9
    assert minhash.near_duplicates(none).count() == 0


def test_token_output(odd, none):
    got = sorted(tokens.token_output(odd.where("doc_id is not null")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [1, 2, 3, 4, 4, 5, 6, 7]
    assert got[0].n_tokens == 1 and got[0].ids_crc32 == zlib.crc32(np.array([2], "<u4").tobytes())
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got])[:-1])
    assert tokens.token_output(none).count() == 0
    assert tokens.token_output(odd).orderBy("start").first().doc_id is None


def test_lengths(odd, none):
    got = {r.n_tokens: r for r in lengths.suffix_sums(lengths.length_histogram(odd)).collect()}
    assert got[0].n_docs == 3 and got[0].docs_from == 9 and got[0].truncated_total == 0
    assert max(got) == max(r.n_tokens for r in got.values()) and got[max(got)].truncated_total == got[0].tokens_from
    assert lengths.suffix_sums(lengths.length_histogram(none)).count() == 0


def test_language_model(odd, none):
    got = ngram.language_model_scores(odd).collect()
    assert len(got) == 9 and all(np.isfinite(r.score) and np.isfinite(r.base_score) for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 6)} == {1}
    assert ngram.language_model_scores(none).count() == 0


def test_toxicity(spark, odd, none):
    labels = spark.createDataFrame([(3, 1), (3, 0), (5, 0), (7, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score(odd, toxicity.learn(odd, labels)).collect()
    assert len(got) == 9 and all(0 <= r.score <= 1 for r in got)
    flat = toxicity.score(odd, toxicity.learn(odd, labels.limit(0))).collect()
    assert {r.score for r in flat} == {0.5}
    assert toxicity.score(none, toxicity.learn(none, labels)).count() == 0


def test_contamination(spark, odd, none):
    bench = spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven"), (1, "two three four five six seven eight nine ten eleven"), (2, None), (3, "!!"), (None, "one"), (9, "b")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.contamination(odd, bench).collect()}
    assert got[3] == (12, 10, 1, True) and got[7] == (2, 1, 1, True) and got[1] == (0, 0, 0, False)
    assert decontaminate.contamination(odd, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(none, bench).count() == 0
    parts = decontaminate.contamination(odd, bench, part_words=1)
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in parts.collect()} == got


def test_mixing(odd, none):
    got = mixing.mix_sources(odd, {"a": 2, "b": 1, None: 1}).collect()
    assert len(got) == 9 and {r.score for r in got} == {"x"}
    assert mixing.mix_sources(none).count() == 0


def test_chat(spark):
    shape = "conv_id long, turn long, role string, text string, span string, piece string"
    rows = [(1, 0, "assistant", "hi"), (1, 1, "User", None), (1, 2, "user", "b"), (2, None, None, None), (None, 0, "user", "x"), (3, 0, "user", "a"), (3, 0, "user", "a")]
    got = chat.repair(spark.createDataFrame([(*r, "s", "p") for r in rows], shape)).collect()
    assert len(got) == 7
    one = sorted((r for r in got if r.conv_id == 1), key=lambda r: r.turn)
    assert [r.action for r in one] == ["relabel", "merge", "merge"] or sum(r.cost for r in one) <= 4.0
    assert sorted(r.action for r in got if r.conv_id == 3) == ["keep", "merge"]
    assert chat.repair(spark.createDataFrame([], shape)).count() == 0


def test_pages(spark):
    shape = "page_id long, url string, html string, lines int, own string"
    art = "<body><div class='ad'>buy</div><article><h1>T &amp; t</h1><p>a<b>b</b> c<br>d<div class=comments>no</div></article><footer>f</footer>"
    plain = "<body><p>shared line of the site</p><p>{}</p>"
    rows = [(1, "http://h/a", art), (1, "http://h/a", art), (2, None, art), (3, "http://g/x/1", plain.format("the first page's own text, much longer than the shared line")), (4, "http://g/x/2", plain.format("the second page's own text, also longer than the line they share")), (5, "http://e/", None), (6, "http://e/", "")]
    got = {r.page_id: r for r in pages.extract_pages(spark.createDataFrame([(*r, 1, "o") for r in rows], shape)).collect()}
    assert got[1].text == got[2].text == "T & t ab c d" and got[1].n_chars == 12
    assert got[3].text.startswith("the first") and got[3].neighbour == 4 and got[3].n_shared == 1
    assert got[5].text == got[6].text == ""
    assert pages.extract_pages(spark.createDataFrame([], shape)).count() == 0


def read_pages(spark, rows, **options):
    return {r.page_id: r for r in pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), **options).collect()}


def test_shared_lines_go_from_the_article_and_copies_stay(spark):
    own = lambda k: " ".join(f"own{k}x{i}" for i in range(120))
    rest = "".join(f"<div>menu {j} " + "of the site " * 60 + "</div>" for j in range(4))
    bar = "<p>pass this on to your friends</p>"
    rows = [(k, f"http://open/{k}", f"<body>{rest}<div>{own(k)}</div>") for k in (1, 2)]
    rows += [(k, f"http://marked/{k}", f"<body><article><p>{own(k)}</p>{bar}</article>") for k in (3, 4)]
    # two copies and a page with the same bar; a copy alone with its copy
    rows += [(k, f"http://copies/a/{k}", f"<body><article><p>{own(0)}</p><p>{own(9)}</p>{bar}</article>") for k in (5, 6)]
    rows += [(7, "http://copies/b", f"<body><article><p>{own(7)}</p>{bar}</article>"), (8, "http://two/a", f"<body><p>{own(8)}"), (9, "http://two/b", f"<body><p>{own(8)}")]
    got = {k: r.text for k, r in read_pages(spark, rows).items()}
    assert [got[k] for k in (1, 2, 3, 4, 7, 8, 9)] == [own(k) for k in (1, 2, 3, 4, 7, 8, 8)]
    assert got[6] == own(0) + " " + own(9)


def test_the_neighbour_is_nearest_on_a_host_of_any_size(spark, monkeypatch):
    import os

    monkeypatch.setattr(pages, "GROUP", 4, raising=False)
    long = "section/" * 12
    paths = sorted([f"{long}{a}/{b}/{c}" for a in "xyz" for b in range(4) for c in range(3)] + [f"{long}y/q", "a", "zz"])
    rows = [(i, f"http://big/{p}", f"<body><p>text {i}") for i, p in enumerate(paths)]
    rows += [(900 + i, f"http://h{i}/", "<p>x") for i in range(9)] + [(950 + i, None, "<p>x") for i in range(9)]
    got = read_pages(spark, rows, **({"task_rows": 3} if hasattr(pages, "TASK_ROWS") else {"group": 4}))
    common = lambda i, j: len(os.path.commonprefix([paths[i], paths[j]])) if 0 <= j < len(paths) else -1
    for i in range(len(paths)):
        assert got[i].neighbour == (i - 1 if common(i, i - 1) >= common(i, i + 1) else i + 1), paths[i]
    assert len(got) == len(rows) and all(got[i].neighbour is None for i in got if i >= 900)


def test_raw_tags_lose_no_article():
    text = lambda html: pages.main_text(pages.page_lines(html), set())[0]
    for raw in ("<svg class='i' />", "<math/>", "<svg/><p><svg>x</svg></p>", "<noscript>", "<object data=x>", "<canvas>", "<svg>", "<script>x</script>", "<svg><path/></svg>"):
        assert text(f"<body>{raw}<article><p>the text</p></article><p>after") == "the text", raw
    assert text("<body><svg/><p>kept</p><svg>x</svg>") == "kept"
    assert text("<body><p>kept</p><script>x<p>y</p>") == "kept"


def test_neighbours(spark):
    shape = "vec_id long, embedding array<double>, block int, dim int"
    nan, inf = float("nan"), float("inf")
    vs = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [0.0, 2.0]), (10, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    v = spark.createDataFrame([(*x, 1, 1) for x in vs], shape)
    got = sorted(map(tuple, ann.nearest_neighbours(v, v.where("vec_id in (0, 3, 10)"), 2).collect()))
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 0.0)]
    assert ann.nearest_neighbours(v.limit(0), v).count() == 0
    assert ann.nearest_neighbours(v, v.limit(0)).count() == 0


def test_pipeline_stages(spark, odd, none, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    for name, start in (("odd", odd), ("none", none)):
        now = start
        for k, (stage, f) in enumerate(corpus_pipeline.STAGES):
            f(spark, now, sf).write.parquet(f"{tmp_path}/{name}{k}")
            after = spark.read.parquet(f"{tmp_path}/{name}{k}")
            if stage != corpus_pipeline.STAGES[-1][0]:
                assert after.columns == start.columns
            now = after
        assert now.count() == (0 if name == "none" else 7), name


def test_vocabulary_is_found():
    assert tokenizer_file("word_bpe_49k.json").endswith(".json")
