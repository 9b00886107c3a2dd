"""Alignment of two tokenizers over one corpus: which of their tokens cover the same bytes, and how often.

Method. A token of either side covers a range of the text's bytes. Ends are running sums of token lengths; ends that
both sides have (intersect1d) cut the tokens into groups, and a token's group is its end's place among the cuts
(searchsorted). Tokens whose ranges overlap are linked: for each token of A the first and last overlapping token of
B are searched, and the links are made by repeating each token as often as it has partners. All of it runs on the
distinct segments of a batch of texts at once. A segment begins at a blank after a character that is no white space:
there both tokenizers start anew, so a text's tokens are those of its segments in order. Where a tokenizer's file does not
say so, a text is one segment.

Counts. Each batch gives its distinct pairs with their numbers; these are summed by (pair, salt) and then by pair. The
corpus-wide counts come back to the batches, one row a batch, and links are weighed there: neither links nor
texts are shuffled, and no table of pairs is broadcast. A batch is written once, with its segments' codes.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexilake.llm.common import Workspace, bounded_batches, give_back, released, tokenizer_file
from lexilake.llm.tokens import text_groups

SALTS = 16
TOGETHER, GROUP = 1024, 4 << 20
BLANK = "▁"
OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
BATCH = "batch long, payload binary, pair array<long>, n array<long>"
PAIR = 32
MARKS = ",|;"


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable Latin-1 stands for itself, other bytes in
    order for the letters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in set(plain))
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers of a worker. ids_a and ids_b take texts that begin with a blank, which B adds itself."""

    _open: dict[tuple[str, str], Tokenizers] = {}

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        spec = json.loads(self.a.to_str())
        letters = byte_letters()
        size = self.a.get_vocab_size(True)
        self.bytes_a = [bytes(letters[c] for c in t) if t and all(c in letters for c in t) else t.encode() for t in ((self.a.id_to_token(i) or "") for i in range(size))]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.joined_a, self.joined_b = (pa.array(side, pa.large_binary()) for side in (self.bytes_a, self.bytes_b))
        # ids as text with what may follow one: a token of its group and side, the other side, the next group
        self.stride = max(size, len(pieces))
        self.named = pa.array([f"{i}{mark}".encode() for mark in MARKS for i in range(self.stride)], pa.large_binary())
        self.length_a, self.length_b = (np.array([len(x) for x in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        self.blank = self.b.piece_to_id(BLANK)
        level = spec["pre_tokenizer"] or {}
        self.cuts = (
            spec["normalizer"] is None and level.get("type") == "ByteLevel" and bool(level.get("use_regex")) and not level.get("add_prefix_space")
            and spec["model"]["type"] == "BPE" and not spec["model"]["dropout"] and spec["post_processor"] in (None, spec["pre_tokenizer"])
            and not any(BLANK in p.lstrip(BLANK) for p in pieces) and self.b.id_to_piece(self.blank) == BLANK
            and all("".join(self.b.encode_as_pieces(t)) == BLANK + t.replace(" ", BLANK) for t in (" x  y ", "x", "é é"))
        )

    @classmethod
    def of(cls, a: str, b: str) -> Tokenizers:
        if (a, b) not in cls._open:
            cls._open[a, b] = cls(a, b)
        return cls._open[a, b]

    def ids_a(self, texts: list[str]) -> list[list[int]]:
        """A few at a time: the library's own results are many times the size of their ids."""
        return [e.ids for i in range(0, len(texts), TOGETHER) for e in self.a.encode_batch_fast(texts[i : i + TOGETHER], add_special_tokens=False)]

    def ids_b(self, texts: list[str]) -> list[list[int]]:
        found = self.b.encode([t[1:] for t in texts], num_threads=1)
        return [ids if ids or len(t) > 1 else [self.blank] for t, ids in zip(texts, found, strict=True)]


def segment_starts(data: np.ndarray, firsts: np.ndarray, cuts: bool) -> np.ndarray:
    """Where segments begin: at firsts, the texts' first bytes, and at blanks after what is surely no white space (an
    ASCII mark, digit or letter, or a character of U+00C0 to U+07FF)."""
    if not cuts or len(data) < 3:
        return firsts
    at = np.flatnonzero(data[2:] == 0x20) + 2
    one, two = data[at - 1], data[at - 2]
    sure = ((one > 0x20) & (one < 0x7F)) | ((one >= 0x80) & (one < 0xC0) & (two >= 0xC3) & (two < 0xE0))
    return np.union1d(firsts, at[sure])


def alignment(length_a: np.ndarray, length_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cuts, group of each A token, group of each B token, A and B token of each link) of two runs of tokens, given by
    their lengths in bytes, that cover the same bytes."""
    end_a, end_b = np.cumsum(length_a), np.cumsum(length_b)
    cuts = np.intersect1d(end_a, end_b, assume_unique=True)
    first = np.searchsorted(end_b, end_a - length_a, "right")
    n = np.searchsorted(end_b - length_b, end_a, "left") - first
    link_a = np.repeat(np.arange(len(n)), n)
    link_b = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(link_a))
    return cuts, np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b), link_a, link_b


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))])
    return np.fromiter(itertools.chain.from_iterable(lists), np.int64, int(at[-1])), at


def _joined(values: pa.LargeBinaryArray, at: np.ndarray) -> tuple[pa.Buffer, np.ndarray]:
    """(values at some places, end to end; where each begins, and the end)."""
    found = values.take(pa.array(at))
    ends = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1, 8 * found.offset)
    return (found.buffers()[2] or pa.py_buffer(b"")).slice(int(ends[0]), int(ends[-1] - ends[0])), ends - ends[0]


def _covers(ids: np.ndarray, at: np.ndarray, known: list[bytes], joined: pa.LargeBinaryArray, lengths: np.ndarray, segments: list[bytes]) -> np.ndarray:
    """Which segments are the joined bytes of their tokens."""
    ends = np.concatenate([[0], np.cumsum(lengths[ids])])
    ok = np.diff(ends[at]) == np.fromiter(map(len, segments), np.int64, len(segments))
    if ok.all() and _joined(joined, ids)[0].equals(pa.py_buffer(b"".join(segments))):
        return ok
    own = ids.tolist()
    for i in np.flatnonzero(ok).tolist():
        ok[i] = b"".join([known[x] for x in own[at[i] : at[i + 1]]]) == segments[i]
    return ok


class Segments:
    """The distinct segments of a batch with their tokens, groups (as text, each with a mark after it) and links. Segments whose tokens of either side do
    not give back their bytes are not ok and have none."""

    def __init__(self, distinct: pa.Array, tok: Tokenizers):
        parts = distinct.to_pylist()
        texts = [x.decode() for x in parts]
        lists_a, lists_b = tok.ids_a(texts), tok.ids_b(texts)
        self.ok = _covers(*_flat(lists_a), tok.bytes_a, tok.joined_a, tok.length_a, parts) & _covers(*_flat(lists_b), tok.bytes_b, tok.joined_b, tok.length_b, parts)
        for i in np.flatnonzero(~self.ok).tolist():
            lists_a[i] = lists_b[i] = []
        (a, at_a), (b, at_b) = _flat(lists_a), _flat(lists_b)
        cuts, group_a, group_b, link_a, link_b = alignment(tok.length_a[a], tok.length_b[b])
        k = np.arange(len(cuts) + 1)
        first_a, first_b = np.searchsorted(group_a, k), np.searchsorted(group_b, k)
        del parts, texts, lists_a, lists_b
        # a group's tokens of A stand before those of B: so each token's place among all, and the mark after it
        mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        mark_a[first_a[1:] - 1], mark_b[first_b[1:] - 1] = 1, 2
        named = np.empty(len(a) + len(b), np.int64)
        named[np.arange(len(a)) + first_b[group_a]] = mark_a * tok.stride + a
        named[np.arange(len(b)) + first_a[group_b + 1]] = mark_b * tok.stride + b
        data, begins = _joined(tok.named, named)
        self.names = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.ok), [None, pa.py_buffer(begins[at_a + at_b]), data])
        del named, begins, mark_a, mark_b
        # a segment ends where both sides do: its groups are those up to its last token's
        at_g = np.searchsorted(first_a, at_a)
        at_l = np.searchsorted(link_a, at_a)
        self.n_a, self.n_b, self.n_groups, self.n_links = (np.diff(x) for x in (at_a, at_b, at_g, at_l))
        self.at_l = at_l
        self.keys = (a[link_a] << PAIR) | b[link_b]


def _pack(**arrays) -> bytes:
    """Arrays under names, compressed."""
    columns = [pa.LargeListArray.from_arrays(pa.array([0, len(x)], pa.int64()), x if isinstance(x, pa.Array) else pa.array(x)) for x in arrays.values()]
    b = pa.RecordBatch.from_arrays(columns, list(arrays))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(b)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> dict[str, pa.Array]:
    b = pa.ipc.open_stream(data).read_next_batch()
    return {name: b.column(i).values for i, name in enumerate(b.schema.names)}


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive places."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[at[1:]] - total[at[:-1]]


def aligned_batch(doc_ids: pa.Array, texts: pa.Array, tok: Tokenizers) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(packed documents, distinct pairs, their numbers) of one batch of texts."""
    binary = texts.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    length = np.diff(np.frombuffer(binary.buffers()[1], np.int64, len(binary) + 1, 8 * binary.offset))
    some = np.flatnonzero(length > 0)
    data = b"".join(b" " + x.as_py() for x in binary.take(pa.array(some)))
    firsts = np.concatenate([[0], np.cumsum(length[some] + 1)])
    starts = segment_starts(np.frombuffer(data, np.uint8), firsts[:-1], tok.cuts)
    offsets = pa.array(np.append(starts, len(data)), pa.int64())
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, offsets.buffers()[1], pa.py_buffer(data)]).dictionary_encode()
    del data
    codes, seg = coded.indices.to_numpy(), Segments(coded.dictionary, tok)
    at = np.zeros(len(length) + 1, np.int64)
    at[some + 1] = np.diff(np.searchsorted(starts, firsts))
    at = np.cumsum(at)
    # a text with a segment whose bytes do not come back has no tokens at all
    whole = _sums((~seg.ok)[codes].astype(np.int64), at) == 0
    keep = np.repeat(whole, np.diff(at))
    codes, at = codes[keep], np.concatenate([[0], np.cumsum(np.diff(at) * whole)])
    digests = []
    for p, q in itertools.pairwise(at.tolist()):
        h = hashlib.sha256()
        for x in range(p, q, 1 << 16):  # a long text's groups are never one string
            data, _ = _joined(seg.names, codes[x : min(q, x + (1 << 16))])
            h.update(data if x + (1 << 16) < q else data.slice(0, data.size - 1))  # the last mark is not of the text
        digests.append(h.hexdigest() if q > p else "")
    times = np.bincount(codes, minlength=len(seg.ok))
    pair, of_link = np.unique(seg.keys, return_inverse=True)
    n = np.zeros(len(pair), np.int64)
    np.add.at(n, of_link, np.repeat(times, seg.n_links))
    counts = {f"n_{x}": _sums(getattr(seg, f"n_{x}")[codes], at) for x in ("a", "b", "groups", "links")}
    small = codes.astype(np.uint16 if len(seg.ok) < 1 << 16 else np.uint32)
    packed = _pack(doc_id=doc_ids.cast(pa.int64()), **counts, digest=pa.array(digests, pa.string()), at=at, codes=small, at_link=seg.at_l, of_link=of_link.astype(np.uint32))
    return packed, pair, n


def align(docs: DataFrame, tokenizer_a: str | None = None, tokenizer_b: str | None = None) -> DataFrame:
    """One row per row of docs(doc_id, text) as in OUT; other columns are ignored.

    Texts null or empty, or whose tokens of either side do not give back a blank and the text, have no tokens: zeros
    and an empty digest. Repeated rows count again. A null doc_id stays null. An empty table has no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark, 512)
    work = Workspace(spark, "alignment")
    a, b = tokenizer_a or tokenizer_file("byte_bpe_50k.json"), tokenizer_b or tokenizer_file("piece_bpe_32k.model")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok, part = Tokenizers.of(a, b), TaskContext.get().partitionId()
        for k, rows in enumerate(text_groups(batches, 1, GROUP)):
            packed, pair, n = aligned_batch(rows.column(0), rows.column(1), tok)
            del rows
            listed = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.int64())) for x in (pair, n)]
            yield pa.RecordBatch.from_arrays([pa.array([(part << 32) | k], pa.int64()), pa.array([packed], pa.binary()), *listed], ["batch", "payload", "pair", "n"])
            del packed, pair, n, listed
            give_back()

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    batches = work.save(narrow.mapInArrow(released(encode), BATCH))
    counts = work.save(pair_counts(batches))
    found = batches.select("batch", F.posexplode("pair").alias("place", "pair")).join(counts, "pair")
    weights = found.groupBy("batch").agg(F.collect_list(F.struct("place", "count", "best")).alias("w"))  # the distinct pairs of one batch

    def weigh(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for i in range(batch.num_rows):
                x = _unpack(batch.column(0)[i].as_py())
                codes, at, at_link = (x[k].to_numpy() for k in ("codes", "at", "at_link"))
                of_link = x["of_link"].to_numpy()
                w = batch.column(1)[i].values
                sums = []
                for name in ("best", "count"):
                    value = np.zeros(len(w) if w is not None else 0, np.int64)
                    if w is not None:
                        value[w.field("place").to_numpy()] = w.field(name).to_numpy()
                    sums.append(pa.array(_sums(_sums(value[of_link], at_link)[codes], at)))
                yield pa.RecordBatch.from_arrays([x["doc_id"], *(x[f"n_{k}"] for k in ("a", "b", "groups", "links")), *sums, x["digest"]], [k.split()[0] for k in OUT.split(", ")])

    return batches.select("batch", "payload").join(weights, "batch", "left").select("payload", "w").mapInArrow(released(weigh), OUT)


def pair_counts(batches: DataFrame) -> DataFrame:
    """pair, count (over the corpus), best (1 if no other pair of its B id has a higher count) of batches(batch, pair, n)."""
    each = batches.select("batch", F.explode(F.arrays_zip("pair", "n")).alias("x")).select(F.col("x.pair").alias("pair"), F.col("x.n").alias("n"), F.pmod(F.xxhash64("batch"), F.lit(SALTS)).alias("salt"))
    total = each.groupBy("pair", "salt").agg(F.sum("n").alias("n")).groupBy("pair").agg(F.sum("n").alias("count"))
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << PAIR) - 1)))  # one row an A id at most
    return total.select("pair", "count", (F.col("count") == F.max("count").over(of_b)).cast("long").alias("best"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
