"""Source divergence against plain Python on whole numbers."""

import re
from collections import Counter, defaultdict

from lexilake.llm import divergence


def plain(rows, least=3, top=200):
    text_of = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text_of(t))) for t, lang, source in rows]
    out = []
    for lang in {x[0] for x in docs}:
        own, seen = defaultdict(Counter), Counter()
        for k, source, words in docs:
            if k == lang:
                own[source].update(words)
                seen.update(set(words))
        kept = [w for w, n in seen.items() if n >= least]
        share = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (sum(c[x] for x in kept) + len(kept)) for w in kept}
        p = {s: share(c) for s, c in own.items()}
        q = share(sum(own.values(), Counter()))
        for s in p:
            parts = {"pair": [(sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept), o) for o in p if o != s]}
            parts["term"] = [((p[s][w] - q[w]) ** 2 // q[w], w) for w in kept if own[s][w] and p[s][w] > q[w]]
            for part, items in parts.items():
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(ranked, 1) if part == "pair" or i <= top]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, source string, term string, n int")


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_nulls_case_and_ties(spark):
    rows = [
        ("The the THE cat", "en", "a"), ("the cat, Été été", "en", "b"), ("the\x00cat1dog", "en", None), ("dog the", "en", "a"), ("Été the dog x", "en", "c"), ("Été", "en", "c"), ("the cat", "en", "b"),
        (None, "en", "d"), ("", "en", "d"), ("12 34 !!", None, None), ("un deux", None, "a"), (None, None, None), ("solo solo", "fr", "z"), ("\U00010400 ！", "en", "a"), ("\U00010400 ！", "en", "b"), ("\U00010400 ！", "en", "c"),
        ("the cat", "en", "b"), ("the cat", "en", "b"),
    ]
    assert got(divergence.divergence(frame(spark, rows))) == plain(rows)
    assert got(divergence.divergence(frame(spark, rows), least_docs=1, top=2)) == plain(rows, 1, 2)
    assert got(divergence.divergence(frame(spark, rows).limit(0))) == []


def test_many_terms_and_a_hot_source(spark):
    rows = [(" ".join(f"{'abcdefghij'[(i * k) % 10]}{'klmnopqrst'[k % 10]}{'uvwxyz'[(i + k) % 6]}" for k in range(60)), "en" if i % 5 else "de", "hot" if i % 3 else f"s{i % 4}") for i in range(150)]
    rows.append(("very " * 200_000, "en", "long"))
    assert got(divergence.divergence(frame(spark, rows).repartition(5))) == plain(rows)


def test_counts_beyond_the_range_of_longs_are_exact(spark):
    row = spark.range(1).select(divergence.share("90000000000000000 + id", "95000000000000000 + id", "1000000").alias("p")).first()
    assert row.p == 1 + 10**9 * (90000000000000000 + 1) // (95000000000000000 + 1000000)
