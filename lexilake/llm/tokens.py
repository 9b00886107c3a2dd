"""Token ids of whole texts, and their storage as directly addressable codes.

Ids. Where a tokenizer's file says that white space only parts words, texts are cut at ASCII white space and each
distinct word is encoded about once a worker by the tokenizers library; ids of a text are those of its words in
order. Other tokenizers encode texts whole.

File format (one block; all numbers little-endian):
    magic b"DAC1", then uint32: documents D, bits per chunk, levels L, size of an optional id S
    uint64: ids N; int64 x D: doc_id; uint64 x (D + 1): position of each document's first id
    per level: uint64 length n, then n chunks of one byte each; but for the last level a bitmap of n bits
    (1: the id goes on in the next level), padded to 64 bits, and its rank directory: uint32 per 64-bit word, the
    ones before that word.
An id is split into chunks of 8 bits, lowest first. The chunk of id i in level 0 stands at i; if its bit is set,
the next chunk stands at rank(i) of the next level, and so on: any id is read without decoding others
(Brisaboa, Ladra, Navarro, "DACs: Bringing Direct Access to Variable-Length Codes").

Blocks are rows of a Parquet table, sorted by position and not compressed, which any store that Spark writes can
hold. Any position of the whole output is found by its block's start (tokens_at).
"""

from __future__ import annotations

import itertools
import json
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexilake.llm.common import Workspace, bounded_batches, released, tokenizer_file

MAGIC, BITS = b"DAC1", 8
BLOCK_IDS = 1 << 18
BLOCK_SCHEMA = "part int, block int, first_doc long, n_docs int, n_ids long, payload binary"


# How a tokenizer file says that white space only parts words, and words then fall into runs of letters,
# single digits and runs of other characters. Texts are cut into words for such files alone.
WORD_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
}
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_PIECES = [
    {"type": "Split", "pattern": {"Regex": WORD_SPLIT}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: beyond these letters case is left to the tokenizer; so is U+0130, whose small form is two characters
FOLDED = r"^[a-zA-Z\x{C0}-\x{12F}\x{131}-\x{24F}]*$"


class Encoder:
    """ids of texts by the tokenizers library; each distinct word of a worker's texts is encoded about once.

    A word is a run without ASCII white space. Letters with closing ASCII marks are two keys, the letters and the
    marks, and Latin letters are folded: none of this changes ids where the file is as WORD_* say. New keys of
    letters alone are encoded many at a time, joined by blanks: each is one piece, and ids that end a piece are known.
    Keys are kept in two generations of bounded size; the older one goes when the younger is full, so a reused worker
    stays small and a frequent word is never lost.
    """

    _open: dict[str, Encoder] = {}
    GENERATION = 100_000
    TOGETHER = 1024

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        added = self.tok.get_added_tokens_decoder().values()
        plain = all(not (t.normalized or t.lstrip or t.rstrip or t.single_word) and not t.content.isalpha() and len(t.content.split()) == 1 for t in added)
        suffix = spec["model"].get("end_of_word_suffix")
        self.cuts = bool(
            plain and suffix and spec["normalizer"] == WORD_NORMALIZER and (spec["pre_tokenizer"] or {}).get("pretokenizers") == WORD_PIECES
            and spec["model"]["type"] == "BPE" and not spec["model"]["dropout"] and spec["post_processor"] is None and spec["truncation"] is None and spec["padding"] is None
        )
        if self.cuts:
            vocabulary = self.tok.get_vocab(False)
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The encoder of this worker for a file; workers serve many tasks."""
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def forget(self) -> None:
        """Empties the cache, for a worker that other stages use next."""
        self.young, self.old = {"": b""}, {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Words of letters alone, joined by blanks; one by one where they are not one piece each after all."""
        ids = np.array(self.tok.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self.ends[np.minimum(ids, len(self.ends) - 1)]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return self._encode(words)
        data, at = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [data[a:z] for a, z in itertools.pairwise(at)]

    def _look(self, keys: pa.Array) -> list[bytes]:
        """ids of each of some distinct keys, as bytes."""
        young, old = self.young, self.old
        names = keys.to_numpy(zero_copy_only=False).tolist()
        found = list(map(young.get, names))
        missing = [i for i, x in enumerate(found) if x is None]
        if not missing:
            return found
        for i in missing:
            found[i] = old.get(names[i])
        letters = pc.utf8_is_alpha(keys).to_numpy(zero_copy_only=False)
        new = np.array([i for i in missing if found[i] is None], np.int64)
        for kind, encode in ((new[letters[new]], self._letters), (new[~letters[new]], self._encode)):
            for a in range(0, len(kind), self.TOGETHER):
                part = kind[a : a + self.TOGETHER].tolist()
                for i, x in zip(part, encode([names[i] for i in part]), strict=True):
                    found[i] = x
        if len(young) + len(missing) > self.GENERATION:
            self.old, self.young = young, {"": b""}
        # keys too long to come again are not kept
        self.young.update((names[i], found[i]) for i in missing if len(names[i]) < 64)
        return found

    def _words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """(number of every word of texts, words before each text and after the last, ids of each distinct word)."""
        runs = pc.split_pattern(pc.replace_substring_regex(texts.cast(pa.large_string()), r"[\t-\r]", " "), " ")
        coded = runs.flatten().dictionary_encode()
        word = coded.dictionary
        core = pc.utf8_rtrim(word, MARKS)
        latin = pc.match_substring_regex(core, FOLDED)
        letters = pc.and_(pc.utf8_is_alpha(core), pc.or_(latin, _stay_letters(core, latin)))
        key = pc.if_else(latin, pc.utf8_lower(core), core)
        key = pc.if_else(letters, key, word).dictionary_encode()
        of_key = self._look(key.dictionary)
        ids = [of_key[i] for i in key.indices.to_numpy().tolist()]
        at = np.flatnonzero(pc.and_(letters, pc.not_equal(pc.binary_length(core), pc.binary_length(word))).to_numpy(zero_copy_only=False))
        if len(at):
            mark = pc.replace_substring_regex(word.take(pa.array(at)), r"(?s)^.*[^!-/:-@\[-`{-~]", "").dictionary_encode()
            of_mark = self._look(mark.dictionary)
            for i, k in zip(at.tolist(), mark.indices.to_numpy().tolist(), strict=True):
                ids[i] += of_mark[k]
        return coded.indices.to_numpy(), runs.offsets.to_numpy(), ids

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text of a string array; a null is empty."""
        texts = pc.fill_null(texts, "")
        if not self.cuts:
            return np.array([len(e.ids) for t in texts for e in self.tok.encode_batch_fast([t.as_py()], add_special_tokens=False)], np.int64)
        number, at, ids = self._words(texts)
        each = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        before = np.concatenate([[0], np.cumsum(each[number])])
        return before[at[1:]] - before[at[:-1]]

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a string array in a row, ids before each text and after the last)."""
        texts = pc.fill_null(texts, "")
        if not self.cuts:
            own = [np.array(e.ids, "<u4") for t in texts for e in self.tok.encode_batch_fast([t.as_py()], add_special_tokens=False)]
            return np.concatenate([*own, np.empty(0, "<u4")]), np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
        number, at, ids = self._words(texts)
        each = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        start = np.cumsum(each) - each
        n = each[number]
        before = np.concatenate([[0], np.cumsum(n)])
        place = np.repeat(start[number] - before[:-1], n) + np.arange(before[-1])
        return np.frombuffer(b"".join(ids), "<u4")[place], before[at]

    def ids(self, text: str | None) -> np.ndarray:
        return self.flat(pa.array([text], pa.string()))[0]


def _stay_letters(words: pa.Array, skip: pa.Array) -> pa.Array:
    """Which words, but for those to skip, a tokenizer's normalizer leaves as they are or makes letters of one for one."""
    if pc.all(skip).as_py():
        return skip
    some = pc.if_else(skip, "", words)
    return pc.and_(pc.equal(pc.utf8_normalize(some, "NFC"), some), pc.invert(pc.match_substring(some, "\u0130")))


def text_groups(batches: Iterator[pa.RecordBatch], column: int, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of batches in groups of about size bytes of text (a longer text alone): more words to a look-up."""
    held, room = [], 0
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < b.num_rows:
            done = int(ends[a - 1]) if a else 0
            z = max(a + 1, int(np.searchsorted(ends, done + size - room, "right")))
            held.append(b.slice(a, z - a))
            room += int(ends[z - 1]) - done
            a = z
            if room >= size or a < b.num_rows:
                yield _joined(held)
                held, room = [], 0
    if held:
        yield _joined(held)


def _joined(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
    return rows[0] if len(rows) == 1 else pa.Table.from_batches(rows).combine_chunks().to_batches()[0]


def dac_encode(doc_ids: Sequence[int], ids: Sequence[np.ndarray]) -> bytes:
    """One block: the ids of some documents, in order."""
    starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("<u8")
    rest = np.concatenate([*ids, np.empty(0, "<u4")]).astype(np.uint32)
    levels = []
    while True:
        more = rest >> np.uint32(BITS)
        goes = more > 0
        levels.append((rest.astype(np.uint8), goes))
        if not goes.any():
            break
        rest = more[goes]
    out = [MAGIC, struct.pack("<4I", len(ids), BITS, len(levels), 4), struct.pack("<Q", int(starts[-1])), np.asarray(doc_ids, dtype="<i8").tobytes(), starts.tobytes()]
    for k, (chunk, goes) in enumerate(levels):
        out += [struct.pack("<Q", len(chunk)), chunk.tobytes()]
        if k < len(levels) - 1:
            bits = np.packbits(goes, bitorder="little")
            bits = np.concatenate([bits, np.zeros(-len(bits) % 8, np.uint8)])
            ones = np.add.reduceat(np.concatenate([goes, np.zeros(-len(goes) % 64, bool)]).astype(np.uint32), np.arange(0, len(goes), 64)) if len(goes) else np.empty(0, np.uint32)
            out += [bits.tobytes(), (np.cumsum(ones) - ones).astype("<u4").tobytes()]
    return b"".join(out)


class DacBlock:
    """Reads a block: any id by its position, or all."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a block of directly addressable codes")
        d, self.bits, n_levels, _ = struct.unpack_from("<4I", data, 4)
        (self.n,) = struct.unpack_from("<Q", data, 20)
        at = 28
        self.doc_ids = np.frombuffer(data, "<i8", d, at)
        at += 8 * d
        self.starts = np.frombuffer(data, "<u8", d + 1, at).astype(np.int64)
        at += 8 * (d + 1)
        self.levels = []
        for k in range(n_levels):
            (n,) = struct.unpack_from("<Q", data, at)
            chunk = np.frombuffer(data, np.uint8, n, at + 8)
            at += 8 + n
            words = ranks = None
            if k < n_levels - 1:
                w = -(-n // 64)
                words = np.frombuffer(data, np.uint8, 8 * w, at).view("<u8")
                ranks = np.frombuffer(data, "<u4", w, at + 8 * w)
                at += 12 * w
            self.levels.append((chunk, words, ranks))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value, shift = 0, 0
        for chunk, words, ranks in self.levels:
            value |= int(chunk[i]) << shift
            shift += self.bits
            if words is None:
                break
            word = int(words[i >> 6])
            if not word >> (i & 63) & 1:
                break
            i = int(ranks[i >> 6]) + (word & ((1 << (i & 63)) - 1)).bit_count()
        return value

    def all(self) -> np.ndarray:
        value = np.zeros(0, np.uint32)
        for chunk, words, _ in reversed(self.levels):
            part = chunk.astype(np.uint32)
            if words is not None:
                goes = np.unpackbits(words.view(np.uint8), bitorder="little", count=len(chunk)).astype(bool)
                part[goes] |= value << np.uint32(self.bits)
            value = part
        return value


def write_blocks(docs: DataFrame, path: str, tokenizer: str, end_id: int, order: Sequence[str] = ("doc_id",), block_ids: int = BLOCK_IDS) -> None:
    """Encode docs(doc_id, text) and write them to path in the order given, as blocks of about block_ids ids.

    A null text is empty; each document ends in end_id. Rows of equal order stand in order of their texts; null
    keys come first. A document is never split, so a longer one makes a longer block.
    """
    bounded_batches(docs.sparkSession, 512)
    n = max(docs.rdd.getNumPartitions(), 1)
    keys = [F.col(c) for c in order]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)))
    keys = [F.col(f"_o{i}") for i in range(len(order))]
    placed = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys, "text").select("doc_id", "text", F.spark_partition_id().alias("part"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.of(tokenizer)
        names, held, size, k = [], [], 0, 0

        def row(part):
            nonlocal names, held, size, k
            out = (part, k, names[0], len(names), size, dac_encode([NO_ID if x is None else x for x in names], held))
            names, held, size, k = [], [], 0, k + 1
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(out, kinds, strict=True)], ["part", "block", "first_doc", "n_docs", "n_ids", "payload"])

        part = 0
        for b in text_groups(batches, 1):
            ids, at = enc.flat(b.column(1))
            ids, at = np.insert(ids, at[1:], np.uint32(end_id)), at + np.arange(len(at))
            part = b.column(2)[0].as_py()
            for i, doc in enumerate(b.column(0).to_pylist()):
                names.append(doc)
                held.append(ids[at[i] : at[i + 1]])
                size += int(at[i + 1] - at[i])
                if size >= block_ids:
                    yield row(part)
        if names:
            yield row(part)
        enc.forget()

    # chunks are read by their places, so they aren't compressed
    placed.mapInArrow(released(blocks), BLOCK_SCHEMA).write.option("compression", "none").parquet(path)


#: stands for a null doc_id inside a block
NO_ID = -(2**63)


def block_starts(blocks: DataFrame) -> DataFrame:
    """part, block, n_ids and start (ids of all blocks before it) of written blocks. The driver sees a row a part."""
    sums = {r.part: r.n for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    before, total = {}, 0
    for p in sorted(sums):
        before[p], total = total, total + sums[p]
    w = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = blocks.sparkSession.createDataFrame(list(before.items()), "part int, p0 long")
    own = blocks.select("part", "block", "n_ids", F.coalesce(F.sum("n_ids").over(w), F.lit(0)).alias("b0"))
    return own.join(F.broadcast(firsts), "part").select("part", "block", "n_ids", (F.col("p0") + F.col("b0")).alias("start"))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Documents of written blocks: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and where
    it stands: part, block, place (its first id within the block). Blocks are read where they lie; only these rows
    meet the blocks' starts."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    starts = block_starts(blocks).select("part", "block", F.col("start").alias("b"))

    def documents(batches):
        for b in batches:
            for part, block, data in zip(*(b.column(j).to_pylist() for j in range(3)), strict=True):
                dac = DacBlock(data)
                ids, at = dac.all().astype("<u4"), dac.starts
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(dac.doc_ids, mask=dac.doc_ids == NO_ID),
                        pa.array(np.diff(at)),
                        pa.array([zlib.crc32(ids[a:z]) for a, z in itertools.pairwise(at.tolist())], pa.int64()),
                        pa.array(np.full(len(at) - 1, part, np.int32)),
                        pa.array(np.full(len(at) - 1, block, np.int32)),
                        pa.array(at[:-1]),
                    ],
                    ["doc_id", "n_tokens", "ids_crc32", "part", "block", "place"],
                )

    found = blocks.select("part", "block", "payload").mapInArrow(released(documents), "doc_id long, n_tokens long, ids_crc32 long, part int, block int, place long")
    return found.join(starts, ["part", "block"]).select("doc_id", (F.col("b") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", "part", "block", "place")


def tokens_at(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """position, id for the distinct positions of positions(position) within all ids of the written blocks, each read
    by rank and bitmap from its block without decoding others. Positions null or out of range have no row."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    cell = lambda x: F.expr(f"({x}) div {BLOCK_IDS}")
    starts = block_starts(blocks).where("n_ids > 0").withColumn("cell", F.explode(F.sequence(cell("start"), cell("start + n_ids - 1"))))
    asked = positions.select(F.col("position").cast("long").alias("position")).distinct().withColumn("cell", cell("position"))
    met = asked.join(starts, "cell").where("position >= start and position < start + n_ids")
    # distinct positions of one block: no more than its ids
    wanted = met.groupBy("part", "block").agg(F.first("start").alias("start"), F.collect_list("position").alias("positions"))
    rows = blocks.select("part", "block", "payload").join(wanted, ["part", "block"]).select("payload", "start", "positions")

    def read(batches):
        for b in batches:
            for data, start, at in zip(*(b.column(j).to_pylist() for j in range(3)), strict=True):
                dac = DacBlock(data)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([dac[p - start] for p in at], pa.int64())], ["position", "id"])

    return rows.mapInArrow(read, "position long, id long")


def token_output(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, order: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Write docs(doc_id, text) as blocks in the shared folder and read the files back (see read_blocks)."""
    spark = docs.sparkSession
    work = Workspace(spark, "tokens")
    path = f"{work.root}/blocks"
    write_blocks(docs, path, tokenizer or tokenizer_file("word_bpe_49k.json"), end_id, order)
    return read_blocks(spark, path)


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(spark.read.parquet(f"{sf_dir}/documents.parquet"))
