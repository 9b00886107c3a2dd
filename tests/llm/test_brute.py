"""Operators that SQL can't express, against plain versions on small inputs."""

import hashlib
import math
import os
import random
import re
import unicodedata
import zlib
from collections import Counter
from fractions import Fraction
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexilake.llm import ann, chat, decontaminate, lengths, minhash, mixing, ngram, pages, queries, tokens, toxicity
from lexilake.llm import wordhash as W
from lexilake.llm.common import tokenizer_file

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def documents(spark):
    return sorted(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()))


def spaced(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))


def test_word_hashes_follow_words(documents):
    known = {}
    texts = [t for _, t in documents] + ["x" * 3_000_000 + " y é\x0b z", None, ""]
    h, at = W.hash_texts([None if t is None else t.encode() for t in texts], W.SPACED)
    for i, t in enumerate(texts):
        words = spaced(t)
        own = h[at[i] : at[i + 1]]
        assert len(words) == len(own)
        for w, x in zip(words, own, strict=True):
            assert known.setdefault(w, x) == x
    assert len(set(map(int, known.values()))) == len(known)


def test_op6(spark, documents):
    sets = {i: {tuple(w)} if 0 < len(w := spaced(t)) < 5 else set(zip(*[w[j:] for j in range(5)], strict=False)) for i, t in documents}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.queries()["op6_minhash"](spark, SF).collect()}
    assert got == {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def test_min_max_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 2**63, 100).astype(np.uint64)])
    same = np.mean([np.mean(x == y) for x, y in zip(minhash.min_max(a), minhash.min_max(b), strict=True)])
    assert abs(same - 300 / 500) < 0.15


def test_rare_shingles_lose_no_link(spark, monkeypatch):
    """The prefix filter, used where buckets hold many documents that are no links, gives the same components."""
    rng = random.Random(5)
    common = [f"c{i}" for i in range(60)]
    rows = [(k, " ".join(common + [f"w{rng.randrange(10**6)}" for _ in range(45)])) for k in range(60)]
    rows += [(100 + k, rows[k][1] + f" tail{k}") for k in range(0, 60, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert got == {i: (i - 100 if i >= 100 else i) for i, _ in rows}


def test_op3(spark, documents):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    got = {r.doc_id: r for r in queries.queries()["op3_token_output"](spark, SF).collect()}
    start = 0
    for i, t in documents:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


@pytest.mark.parametrize("text", ["it's o'clock's don't. can't, I'll.", "a　b ÅΣΣ. ΑΣ. é <|endoftext|>. x<|startoftext|>y,", "12,345.67. abc123. \x0bq\x1cq 's. a..,b.. ß. ﬁ, İ.", "", "  ", "?!,. a.,"])
def test_encoder_agrees_with_library(text):
    from tokenizers import Tokenizer

    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = tokenizer_file(name)
        assert list(tokens.Encoder(path).ids(text)) == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_encoder_keeps_the_case_of_added_tokens():
    test_encoder_agrees_with_library("<|ENDOFTEXT|> X<|EndOfText|>. <|endoftext|>Y <|STARTOFTEXT|>, ABC.")


def test_codes_are_addressable():
    rng = np.random.default_rng(2)
    parts = [rng.integers(0, 2**k, 300).astype("<u4") for k in (4, 8, 9, 16, 17, 31)] + [np.empty(0, "<u4")]
    block = tokens.DacBlock(tokens.dac_encode(range(len(parts)), parts))
    every = np.concatenate(parts)
    assert (block.all() == every).all() and all(block[i] == every[i] for i in range(len(every)))
    with pytest.raises(IndexError):
        block[len(every)]


def test_op7(spark, documents):
    data = [(i, zlib.crc32(str(i).encode()) % 10, [*spaced(t), None]) for i, t in documents]
    count = Counter(w for _, f, x in data if f for w in x)
    n, v = sum(count.values()), len(count)
    got = {r.doc_id: r for r in queries.queries()["op7_lm_scores"](spark, SF).collect()}
    for i, f, x in data:
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (f == 0, len(x), sum(count[w] > 0 for w in x), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x), rel=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_weights_recover_a_mixture():
    rng = np.random.default_rng(3)
    p = np.where(rng.random((20_000, 1)) < 0.7, [[0.5, 0.01]], [[0.01, 0.5]])
    w = ngram.learn_weights(np.ones(len(p), np.int64), p, np.ones(len(p)), 1 + ngram.BUCKETS, 60)
    assert abs(w[1, 0] - 0.7) < 0.05 and np.allclose(w.sum(1), 1)


def test_op10(spark, documents):
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = rx.findall((r.text or "").translate(LOWER))
        for a in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[a : a + 10]), set()).add(str(r.item_id))
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in queries.queries()["op10_decontaminate"](spark, SF).collect()}
    for i, t in documents:
        w, hit, items = rx.findall((t or "").translate(LOWER)), set(), set()
        for a in range(len(w)):
            for n in {len(x) for x in windows}:
                if (found := windows.get(tuple(w[a : a + n]))) and len(w[a : a + n]) == n:
                    items |= found
                    hit |= set(range(a, a + n))
        assert got[i] == (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit))
    assert decontaminate.WINDOW == 10


def test_op9_held_out(spark):
    got = {r.doc_id: r for r in queries.queries()["op9_toxicity"](spark, "/root/testdata/sf0.1").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    held = [(got[i].score, y) for i, y in labels.items() if i in got and got[i].held_out]
    pairs = [(a, b) for (a, x), (b, y) in product(held, held) if x == 1 and y == 0]
    assert sum(a > b for a, b in pairs) > 0.9 * len(pairs)
    assert all((r.predicted == 1) == (r.score >= toxicity.THRESHOLD) for r in got.values())


def test_pfair_deviation():
    w = mixing.whole_weights({"a": 5, "b": 3, "c": 1.7, "d": 0.3}, 200)
    table, done = mixing.pfair_period(w), Counter()
    for slot, (s, j) in enumerate(sorted(table, key=table.get)):
        assert table[s, j] == slot and done[s] == j
        done[s] += 1
        assert all(abs(done[x] - w[x] * (slot + 1) / 200) < 1 for x in w)


@pytest.mark.parametrize("weights", [{"a": 0.4, "b": 0.3, "c": 0.2, "d": 0.1}, {"hot": 9.5} | {f"s{i}": 1.0 for i in range(19)}, {"a": 2**0.5, "b": 3**0.5, "c": 1e-3}, {"a": 5, "b": 0}])
def test_phases_keep_to_the_given_weights(weights):
    blocks = dict.fromkeys(weights, 9000)
    first = mixing.phases(blocks, weights, 1000)[0]
    slots = [(at + n * first["period"], s) for (s, _), at in first["table"].items() for n in range(-(-first["length"] // first["period"]))]
    done, given = Counter(), {s: w or sum(weights.values()) / 1000 for s, w in weights.items()}
    assert len([x for x in slots if x[0] < first["length"]]) == first["length"]
    for slot, s in sorted(x for x in slots if x[0] < first["length"]):
        done[s] += 1
        assert all(abs(done[x] - w / sum(given.values()) * (slot + 1)) < 1 + 1e-6 for x, w in given.items())
    assert mixing.whole_weights({"a": 0.4, "b": 0.3, "c": 0.2, "d": 0.1}, 1000) == {"a": 400, "b": 300, "c": 200, "d": 100}


def test_phases_use_every_block_once():
    blocks, slots = {"a": 7, "b": 31, "c": 1}, set()
    for p in mixing.phases(blocks, {"a": 1, "b": 1, "c": 2}, 10):
        for (s, j), at in p["table"].items():
            n = j
            while (slot := at + (n - j) // p["weights"][s] * p["period"]) < p["length"]:
                slots.add((p["slot"] + slot, s, p["first"][s] + n))
                n += p["weights"][s]
    assert sorted(x[0] for x in slots) == list(range(39)) and Counter(x[1] for x in slots) == blocks


def brute_repair(roles):
    """Least cost over all sequences of states, by search over every choice at every turn."""
    best = {0: 0.0}
    for r in roles:
        new = {}
        for s, c in best.items():
            for a, t, _, ins, cost in chat._ways():
                if a == s:
                    total = c + cost + chat.RELABEL * (chat.STATES[t] != (r or "").lower())
                    new[t] = min(new.get(t, 1e9), total)
        best = new
    return min(c for s, c in best.items() if s in chat.FINAL)


def test_repair_is_cheapest_and_spans_join(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", None]), f"t{t}") for c in range(25) for t in range(rng.randrange(1, 14))]
    monkeypatch.setattr(chat, "SPAN", 3)
    got = chat.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for c in range(25):
        mine = sorted((r for r in got if r.conv_id == c), key=lambda r: r.turn)
        assert sum(r.cost for r in mine) == brute_repair([r[2] for r in rows if r[0] == c])
        text, state = "".join(r.piece for r in mine), 0
        for role in re.findall(r"<\|(system|user|assistant)\|>", text):
            assert chat.STATES.index(role) in chat.NEXT[state]
            state = chat.STATES.index(role)
        assert state in chat.FINAL and text.endswith("<|end|>\n")


def test_spans_are_cut_by_rows(spark, monkeypatch):
    monkeypatch.setattr(chat, "SPAN", 4)
    rng = random.Random(8)
    kinds = ["user", "assistant", "system", "tool", None]
    pooled = [(None, t, rng.choice(kinds), f"t{k}") for k in range(20) for t in (*range(4), None)]
    sparse = [(7, 10**9 + 5000 * t, rng.choice(kinds), "x") for t in range(40)]
    same = [(8, 1, "user", "x")] * 30
    df = spark.createDataFrame(pooled + sparse + same, "conv_id long, turn long, role string, text string")
    got = chat.repair(df.coalesce(1)).select("conv_id", "cost", F.spark_partition_id().alias("task")).collect()
    order = lambda r: (r[1] is None, r[1] or 0, r[2] is not None, r[2] or "")
    for conv, rows in ((None, pooled), (7, sparse), (8, same)):
        assert sum(r.cost for r in got if r.conv_id == conv) == brute_repair([r[2] for r in sorted(rows, key=order)])
    assert len({r.task for r in got if r.conv_id is None}) > 1
    # in this process: no span is longer than SPAN, and sparse turns share spans
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 40, pa.int32()), pa.array([7] * 40, pa.int64())], ["part", "conv_id"])
    assert [len(rows) for *_, rows in chat._spans([batch], 4)] == [4] * 10


def test_shared_lines_is_a_longest_common_subsequence():
    rng = random.Random(6)
    for _ in range(60):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert len(pages.shared_lines(a, b)) == table[-1][-1]


def test_codes_bound_the_error():
    rng = np.random.default_rng(8)
    x, q = rng.normal(size=(500, 64)), rng.normal(size=64)
    mean, turn = x.mean(0), ann.rotation(64)
    about, error = ann.Codes(x, mean, turn).estimate(q, mean, turn)
    true = ((x - q) ** 2).sum(1)
    assert np.mean(np.abs(about - true) <= error) > 0.99 and np.corrcoef(about, true)[0, 1] > 0.6


def test_op1_recall(spark):
    v = {r.vec_id: np.array(r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    got = queries.queries()["op1_ann"](spark, SF).collect()
    for q in (i for i in v if i % 100 == 0):
        want = [i for _, i in sorted((float(np.sqrt(((v[q] - x) ** 2).sum())), i) for i, x in v.items() if i != q)[:10]]
        assert len(set(want) & {r.vec_id for r in got if r.query_id == q}) >= 9


def test_encoder_on_every_character():
    """Whatever splits, folds or peels a word, its ids are the library's: every code point, within and at a word's end."""
    enc = tokens.Encoder(tokenizer_file("word_bpe_49k.json"))
    assert enc.cuts
    points = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) not in ("Cn", "Co", "Cs")]
    for a in range(0, len(points), 8192):
        texts = [f"{c}a{c}!? A{c}, {c} {c}{c}." for c in points[a : a + 8192]]
        ids, at = enc.flat(pa.array(texts))
        assert enc.lengths(pa.array(texts)).tolist() == np.diff(at).tolist()
        for k, e in enumerate(enc.tok.encode_batch_fast(texts, add_special_tokens=False)):
            assert ids[at[k] : at[k + 1]].tolist() == e.ids, texts[k]


def test_encoder_stays_small_and_right_when_it_forgets(documents):
    enc = tokens.Encoder(tokenizer_file("word_bpe_49k.json"))
    enc.GENERATION, enc.TOGETHER = 50, 7
    most = max(len(set((t or "").split())) for _, t in documents)
    for _, t in documents:
        assert enc.ids(t).tolist() == enc.tok.encode(t or "", add_special_tokens=False).ids
        assert max(len(enc.young), len(enc.old)) <= 51 + 2 * most  # a word has two keys at most


def test_groups_hold_every_row_once():
    rows = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array([None if i % 7 == 0 else "x" * (i * i % 97) for i in range(50)])], ["i", "t"])
    for size in (1, 40, 200, 10**9):
        got = list(tokens.text_groups(iter([rows.slice(0, 13), rows.slice(13, 0), rows.slice(13)]), 1, size))
        assert pa.Table.from_batches(got).equals(pa.Table.from_batches([rows])) or sum((g.column(0).to_pylist() for g in got), []) == list(range(50))
        assert all(sum(len(x or "") for x in g.column(1).to_pylist()[:-1]) <= size for g in got)


def test_any_position_of_the_output_is_read(spark, documents, tmp_path):
    path, tok = f"file://{tmp_path}/blocks", tokens.Encoder(tokenizer_file("word_bpe_49k.json"))
    tokens.write_blocks(spark.createDataFrame(documents, "doc_id long, text string"), path, tokenizer_file("word_bpe_49k.json"), 2, block_ids=3000)
    every = [x for _, t in documents for x in [*tok.ids(t).tolist(), 2]]
    asked = [-1, len(every), None, *range(0, len(every), 17), 17]
    got = tokens.tokens_at(spark, path, spark.createDataFrame([(p,) for p in asked], "position long")).collect()
    assert sorted(map(tuple, got)) == [(p, every[p]) for p in range(0, len(every), 17)]


def test_op5_suffix_sums_and_answers(spark, documents):
    enc = tokens.Encoder(tokenizer_file("word_bpe_49k.json"))
    n = sorted(len(enc.ids(t)) for _, t in documents)
    got = {r.n_tokens: r for r in queries.queries()["op5_lengths"](spark, SF).collect()}
    assert set(got) == set(n)
    for x, r in got.items():
        over = [y for y in n if y >= x]
        assert (r.n_docs, r.docs_from, r.tokens_from, r.truncated_total) == (n.count(x), len(over), sum(over), sum(min(x, y) for y in n))
        assert r.quantile == pytest.approx(sum(y <= x for y in n) / len(n))
    limits = [0, 1, 7, n[len(n) // 2], n[-1] - 1, n[-1]]
    sums = lengths.suffix_sums(spark.createDataFrame(sorted(Counter(n).items()), "n_tokens long, n_docs long"))
    answers = {r.limit: (r.docs_over, r.truncated_total) for r in lengths.answers(sums, limits).collect()}
    assert answers == {x: (sum(y > x for y in n), sum(min(x, y) for y in n)) for x in limits if any(y > x for y in n)}


def brute_interpolation(data):
    """Scores of (fold, words) rows: counts in dictionaries, weights by a plain loop of expectation-maximisation."""

    def counts(rows):
        grams = [Counter(), Counter(), Counter()]
        for _, x in rows:
            y = ["<s>", *x]
            grams[0].update((w,) for w in x)
            grams[1].update(zip(y, x, strict=False))
            grams[2].update(zip(y, x, x[1:], strict=False))
        return grams, len(rows), sum(grams[0].values()), len(grams[0])

    def parts(x, model):
        (one, two, three), starts, n, v = model
        for i, w in enumerate(x):
            before = x[i - 1] if i else "<s>"
            p, bucket = [(one[w,] + 0.1) / (n + 0.1 * (v + 1)), 0.0, 0.0], 0
            c = one[before,] if i else starts
            if c:
                p[1], bucket = two[before, w] / c, 1 + min(c.bit_length(), ngram.BUCKETS) - 1
            c = two[x[i - 2] if i > 1 else "<s>", before] if i else 0
            if c:
                p[2], bucket = three[x[i - 2] if i > 1 else "<s>", before, w] / c, 1 + ngram.BUCKETS + min(c.bit_length(), ngram.BUCKETS) - 1
            yield bucket, p

    shown = counts([r for r in data if r[0] > 1])
    seen = {}
    for f, x in data:
        if f == 1:
            for b, p in parts(x, shown):
                cell = seen.setdefault(b, {}).setdefault(tuple(round(math.log2(y) * ngram.STEP) if y else None for y in p), [0, 0.0, 0.0, 0.0])
                cell[:] = [cell[0] + 1, *(z + y for z, y in zip(cell[1:], p, strict=True))]
    weights, known = {}, set()
    for b in range(1 + 2 * ngram.BUCKETS):
        use = [1.0, b > 0, b > ngram.BUCKETS]
        even = [u / sum(use) for u in use]
        lam, cells = even, seen.get(b, {})
        for _ in range(ngram.ROUNDS):
            new = list(even)
            for k, *total in cells.values():
                p = [z / k for z in total]
                s = sum(a * y for a, y in zip(lam, p, strict=True))
                new = [z + k * a * y / s for z, a, y in zip(new, lam, p, strict=True)]
            lam = [z / (sum(k for k, *_ in cells.values()) + 1) for z in new]
        # a bucket without tokens takes the one before it in its row
        after = b > 0 and (b - 1) % ngram.BUCKETS and not cells and b - 1 in known
        weights[b] = weights[b - 1] if after else lam
        known |= {b} if cells or after else set()
    model = counts([r for r in data if r[0] > 0])
    return [sum(math.log10(sum(a * y for a, y in zip(weights[b], p, strict=True))) for b, p in parts(x, model)) for _, x in data]


def test_op7_scores_by_plain_interpolation(spark, documents, monkeypatch):
    monkeypatch.setattr(ngram, "PART_TOKENS", 5000)
    got = {r.doc_id: r.score for r in queries.queries()["op7_lm_scores"](spark, SF).collect()}
    want = brute_interpolation([(zlib.crc32(str(i).encode()) % 10, [*spaced(t), "</s>"]) for i, t in documents])
    for (i, _), x in zip(documents, want, strict=True):
        assert got[i] == pytest.approx(x, rel=1e-6)


def test_long_pages_are_aligned_in_parts(monkeypatch):
    rng = random.Random(12)
    pairs = [tuple([rng.randrange(9) for _ in range(rng.randrange(60))] for _ in range(2)) for _ in range(40)]
    want = [len(pages.shared_lines(a, b)) for a, b in pairs]
    monkeypatch.setattr(pages, "TABLE_BITS", 40)
    for (a, b), n in zip(pairs, want, strict=True):
        found = pages.shared_lines(a, b)
        rest = iter(b)
        assert len(found) == n and all(a[i] in rest for i in sorted(found))
    long = [i % 5000 for i in range(30_000)]
    assert len(pages.shared_lines([-1, *long, -2], [-3, *long, -4])) == 30_000


def plain_pages(rows):
    """Texts of (page_id, url, html) rows by a plain table for each pair of neighbours on a host."""

    def shared(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in product(range(len(a)), range(len(b))):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        i, j, out = len(a), len(b), set()
        while i and j:
            if t[i][j] == t[i][j - 1]:
                j -= 1
            elif t[i][j] == t[i - 1][j]:
                i -= 1
            else:
                i, j = i - 1, j - 1
                out.add(i)
        return out

    hosts, out = {}, {}
    for page_id, url, html in rows:
        m = re.match(r"^[a-zA-Z][\w+.-]*://([^/?#]*)([^?#]*)", url or "")
        hosts.setdefault((m[1].lower() if m else ""), []).append((m[2] if m else "", page_id, pages.page_lines(html)))
    alike = lambda a, b: len(os.path.commonprefix([a, b]))
    for host, group in hosts.items():
        group.sort(key=lambda x: (x[0].encode(), x[1]))
        for k, (path, page_id, lines) in enumerate(group):
            sides = [group[j] if host and 0 <= j < len(group) else None for j in (k - 1, k + 1)]
            near, far = sides if not sides[1] or (sides[0] and alike(path, sides[0][0]) >= alike(path, sides[1][0])) else sides[::-1]
            own = [t for _, t in lines]
            gone = shared(own, [t for _, t in near[2]]) if near else set()
            marked = any(z == pages.ARTICLE for z, _ in lines)
            body = [i for i, (z, _) in enumerate(lines) if z == (pages.ARTICLE if marked else pages.OPEN)]
            size = sum(len(own[i]) for i in body)
            if 2 * sum(len(own[i]) for i in body if i not in gone) < size:
                gone = gone & shared(own, [t for _, t in far[2]]) if far else gone
                if sum(len(own[i]) for i in body if i not in gone) < pages.COPY_REST * size:
                    gone = set()
            out[page_id] = " ".join(own[i] for i in body if i not in gone)
    return out


def test_op8_by_plain_differencing(spark):
    rows = list(map(tuple, spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()))
    share = "<body><p>menu of the site</p><div>about us</div><p>{}</p><p>call us any day</p>"
    rows += [(10**6 + k, f"https://plain.example/{k % 3}/{k}", share.format(f"text {k} " + "of its own kind " * k)) for k in range(1, 12)]
    want = plain_pages(rows)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in pages.extract_pages(df, task_rows=20).collect()}
    assert got == want
    # without differencing other texts come out
    alone = {i: pages.main_text(pages.page_lines(html), set())[0] for i, _, html in rows}
    assert sum(alone[i] != want[i] for i in want) >= 11


def test_op4_by_plain_placing(spark):
    rng = random.Random(3)
    rows = [(i, "ab"[i % 3 == 0], "x" * rng.randrange(1, 400)) for i in range(300)] + [(7, "a", "y"), (7, "a", "y"), (None, None, None)]
    weights, size = {"a": 0.5, "b": 0.3, None: 0.2}, 1000
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix_sources(docs, weights, block_chars=size).collect()
    assert sorted((r.doc_id, r.source, r.text) for r in got if r.doc_id is not None) == sorted(r for r in rows if r[0] is not None)
    blocks, first = {}, {}
    for s in weights:
        mine = sorted((r.mix_place, r.doc_id or 0, len(r.text or "")) for r in got if r.source == s)
        assert [p for p, *_ in mine] == [sum(n for *_, n in mine[:k]) for k in range(len(mine))]
        assert all(r.mix_block == r.mix_place // size for r in got if r.source == s)
        blocks[s] = sum(n for *_, n in mine) // size + 1
        for r in got:
            if r.source == s:
                assert first.setdefault((s, r.mix_block), r.mix_slot) == r.mix_slot
    # earliest deadline first, slot by slot, over all blocks
    done, slot, at, since = dict.fromkeys(weights, 0), 0, {}, {}
    while active := [s for s in weights if done[s] < blocks[s]]:
        if since.get("who") != active:
            since = {"who": active, "slot": slot} | {s: done[s] for s in active}
        total = sum(Fraction(str(weights[s])) for s in active)
        w = {s: Fraction(str(weights[s])) / total for s in active}
        ready = [s for s in active if (done[s] - since[s]) / w[s] // 1 <= slot - since["slot"]]
        s = min(ready, key=lambda s: (math.ceil((done[s] - since[s] + 1) / w[s]), -w[s], s is None, s or ""))
        at[s, done[s]] = slot
        done[s] += 1
        slot += 1
    assert first == {k: at[k] for k in first}
