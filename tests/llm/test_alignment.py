"""Token alignment against whole-text encoding and byte-by-byte comparison."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexilake.llm import alignment
from lexilake.llm.common import tokenizer_file

SF = "/root/testdata/sf0.001"
A, B = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def whole():
    """text -> [(id, bytes)] of either side, each text encoded at once by the libraries themselves."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    level = alignment.byte_letters()

    def tokens(text):
        ids = a.encode(" " + text, add_special_tokens=False).ids
        own = [(i, bytes(level[c] for c in a.id_to_token(i))) for i in ids]
        other = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        return own, other

    return tokens


def plain(rows, whole):
    """The contract of op12, a byte at a time."""
    docs, count = [], Counter()
    for doc, text in rows:
        own, other = whole(text) if text else ([], [])
        full = (" " + (text or "")).encode()
        if not text or any(b"".join(x for _, x in side) != full for side in (own, other)):
            docs.append((doc, 0, 0, [], ""))
            continue
        at = [[], []]
        for side, out in zip((own, other), at):
            for k, (_, x) in enumerate(side):
                out += [k] * len(x)
        links = sorted(set(zip(*at)))
        pairs = [(own[i][0], other[j][0]) for i, j in links]
        count.update(pairs)
        groups, a, b = [], [], []
        for p in range(len(full)):
            last = [p + 1 == len(full) or x[p + 1] != x[p] for x in at]
            if last[0]:
                a.append(own[at[0][p]][0])
            if last[1]:
                b.append(other[at[1][p]][0])
            if all(last):
                groups.append(f"{','.join(map(str, a))}|{','.join(map(str, b))}")
                a, b = [], []
        docs.append((doc, len(own), len(other), pairs, ";".join(groups)))
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return sorted(
        ((d, a, b, len(g.split(";")) if g else 0, len(p), sum(count[x] == most[x[1]] for x in p), sum(count[x] for x in p), hashlib.sha256(g.encode()).hexdigest() if g else "") for d, a, b, p, g in docs),
        key=repr,
    )


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_all_documents(spark, whole):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got(alignment.align(docs.repartition(3))) == plain([(r.doc_id, r.text) for r in docs.collect()], whole)


ODD = [
    None, "", " ", "  ", "a", "a ", " a", "a  b", "a \n b", "a\n\nb\t c ", "<|endoftext|> x <s> </s> <unk> <0x41>", "one▁two", "▁", "nul \x00 x", "café crème brûlée", "é ö",
    "　full width　x   y  z  w", "日本語 の テキスト", "\U0001f600 \U0001f468‍\U0001f469 x", "don't we'll I'M", "1234 12 3.14159 1e9", "x" * 5000, "ab " * 3000, "﻿bom x", "tab\t\t x \r\n y", "مرحبا بك", "a\u0085 b \x1c c \x7f d", "² ½   x",
]


def test_odd_texts_repeats_and_clashing_columns(spark, whole):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "a b"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, batch string, pair int, n_a int").repartition(4)
    assert got(alignment.align(docs)) == plain(rows, whole)
    assert got(alignment.align(docs.limit(0))) == []
    assert got(alignment.align(docs.where("text is null"))) == plain([(0, None)], whole)


def test_a_batch_and_a_text_of_any_size_give_the_same(spark):
    rows = [(i, " ".join(f"w{(i * k) % 97}s" for k in range(200))) for i in range(40)] + [(99, "long words here " * 60_000)]
    want = alignment.align(spark.createDataFrame(rows, "doc_id long, text string").repartition(1))
    assert got(want) == got(alignment.align(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \t\n 　▁ab'1.é́"), st.characters(exclude_categories=["Cs"])), min_size=1, max_size=40))
def test_segments_encode_as_the_whole_text(text):
    tok = alignment.Tokenizers.of(A, B)
    assert tok.cuts
    data = (" " + text).encode()
    starts = alignment.segment_starts(np.frombuffer(data, np.uint8), np.array([0]), True)
    parts = [data[x:y].decode() for x, y in zip(starts, [*starts[1:], len(data)])]
    assert sum(tok.ids_a(parts), []) == tok.ids_a([" " + text])[0]
    assert sum(tok.ids_b(parts), []) == tok.b.encode(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=20), st.randoms())
def test_links_and_groups_of_any_cuts(lengths, random):
    total = sum(lengths)
    ends = sorted({*random.sample(range(1, total + 1), random.randint(1, total)), total})
    a, b = np.array(lengths), np.diff([0, *ends])
    cuts, ga, gb, la, lb = alignment.alignment(a, b)
    at = [np.repeat(np.arange(len(x)), x) for x in (a, b)]
    assert sorted(set(zip(at[0].tolist(), at[1].tolist()))) == list(zip(la.tolist(), lb.tolist()))
    assert cuts.tolist() == sorted(set(np.cumsum(a).tolist()) & set(ends))
    assert all(ga[i] == gb[j] for i, j in zip(la, lb))


def test_group_texts_are_arrays():
    """op12_alignment in FINDINGS_r03: a batch's group texts are one buffer, not strings one by one; long texts' digests go over parts."""
    tok = alignment.Tokenizers.of(A, B)
    parts = [b" the", b" contractor's", b" \xc3\xa9t\xc3\xa9", b" x1y2"]
    seg = alignment.Segments(pa.array(parts, pa.large_binary()), tok)
    assert isinstance(seg.names, pa.Array) and seg.ok.all()
    texts = [" ".join("the contractor's été x1y2".split()[(i * i) % 4] for i in range(n)) for n in (1 << 16, (1 << 16) + 1, 140_000, 1)] + ["", None]
    packed, _, _ = alignment.aligned_batch(pa.array(range(6)), pa.array(texts), tok)
    text_of = {p.decode()[1:]: n.as_py().decode().rstrip(";") for p, n in zip(parts, seg.names, strict=True)}
    want = [hashlib.sha256(";".join(text_of[w] for w in t.split()).encode()).hexdigest() if t else "" for t in texts]
    assert alignment._unpack(packed)["digest"].to_pylist() == want
