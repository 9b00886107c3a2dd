"""Benchmark passages in documents, by a prefix-filtered join of word windows.

Each benchmark item gives windows of 10 consecutive words (an item of fewer words is one window). Containment of
a window is asked for in full, so of its words, ordered by rarity over all documents, one prefix word is enough:
its rarest. A document joins a window on that word; the window's place follows from the word's, must lie within
the document (positional and length bound), and is then verified word for word.

The benchmark side is cut into parts of at most PART_WORDS words, whose index is broadcast (32 bytes a word at
most); a larger benchmark makes more parts, which pass over the documents in turn. Documents are never shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexilake.llm import wordhash as W
from lexilake.llm.common import bounded_batches, released

WINDOW = 10
PART_WORDS = 1_000_000
RESULTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def _item_words(batches):
    for b in batches:
        h, at = W.hash_texts(W.utf8(b.column(1)), W.ALNUM)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)))], ["item", "n", "words"])


class _Index:
    """The windows of some items, by their rarest word."""

    def __init__(self, items: pd.DataFrame, counts: dict[int, int], window: int):
        windows: dict[bytes, int] = {}
        self.items: list[set[str]] = []
        spans: list[np.ndarray] = []
        for item, words in zip(items["item"], items["words"], strict=True):
            w = np.asarray(words, dtype=np.int64).view(np.uint64)
            for a in range(max(1, len(w) - window + 1)):
                span = w[a : a + window]
                k = windows.setdefault(span.tobytes(), len(windows))
                if k == len(spans):
                    spans.append(span)
                    self.items.append(set())
                self.items[k].add(str(item))
        self.size = np.array([len(s) for s in spans], dtype=np.int64)
        self.words = np.zeros((len(spans), window), dtype=np.uint64)
        rarest = np.zeros(len(spans), dtype=np.uint64)
        self.offset = np.zeros(len(spans), dtype=np.int64)
        for k, s in enumerate(spans):
            self.words[k, : len(s)] = s
            j = min(range(len(s)), key=lambda j: (counts.get(int(s[j]), 0), int(s[j]), j))
            rarest[k], self.offset[k] = s[j], j
        order = np.argsort(rarest, kind="stable")
        self.windows = order
        self.keys, first = np.unique(rarest[order], return_index=True)
        self.bounds = np.concatenate([first, [len(order)]])

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of every occurrence in the words of one document."""
        if not len(h) or not len(self.keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        pos = np.flatnonzero(self.keys[at] == h)
        key = at[pos]
        many = self.bounds[key + 1] - self.bounds[key]
        rows = np.repeat(self.bounds[key], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        win = self.windows[rows]
        start = np.repeat(pos, many) - self.offset[win]
        ok = (start >= 0) & (start + self.size[win] <= len(h))
        win, start = win[ok], start[ok]
        for j in range(self.words.shape[1]):
            here = j < self.size[win]
            same = ~here | (h[np.minimum(start + j, len(h) - 1)] == self.words[win, j])
            win, start = win[same], start[same]
        return win, start


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_words: int = PART_WORDS) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, contaminated appended.

    docs and benchmark have a text each; benchmark has item_id. A null text has no words. Items without an id or
    words take no part; repeated items count once. Every row of docs comes back with all its columns, but for those
    that bear a result's name.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    items = items.mapInArrow(_item_words, "item string, n long, words array<long>").where("n > 0")
    total = items.agg(F.sum("n")).first()[0] or 0
    parts = -(-total // part_words) if total else 0
    docs = docs.drop(*RESULTS)
    out = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("t"), F.lit(None).cast("binary").alias("hit"), F.array().cast("array<string>").alias("items"), F.lit(0).cast("long").alias("n_words"))
    texts = docs.select(F.col("text").cast("string").alias("t"))
    marks = []
    for k in range(parts):
        part = items.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == k).select("item", "words").toPandas()
        if len(part):
            index = _Index(part, _document_counts(spark, texts, part), window)
            marks.append(_marker(spark.sparkContext.broadcast(index)))
    if not parts:
        marks.append(_marker(spark.sparkContext.broadcast(_Index(pd.DataFrame({"item": [], "words": []}), {}, window))))

    def marked(batches):
        for mark in marks:
            batches = mark(batches)
        return _summary(batches)

    # all parts in one Python worker a task
    return out.mapInArrow(
        released(marked), "row " + docs.schema.simpleString() + ", n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    ).select("row.*", *RESULTS)


def _document_counts(spark: SparkSession, texts: DataFrame, part: pd.DataFrame) -> dict[int, int]:
    """How often each word of some items occurs in all documents."""
    vocabulary = np.unique(np.concatenate([np.asarray(w, dtype=np.int64) for w in part["words"]]).view(np.uint64))
    known = spark.sparkContext.broadcast(vocabulary)

    def count(batches):
        n = np.zeros(len(known.value), dtype=np.int64)
        for b in batches:
            h, _ = W.hash_texts(W.utf8(b.column(0)), W.ALNUM)
            at = np.minimum(np.searchsorted(known.value, h), len(n) - 1)
            n += np.bincount(at[known.value[at] == h], minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["word", "n"])

    rows = texts.mapInArrow(released(count), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    return {int(vocabulary[w]): n for w, n in zip(rows["word"], rows["n"], strict=True)}


def _marker(index):
    def mark(batches):
        for b in batches:
            h, at = W.hash_texts(W.utf8(b.column("t")), W.ALNUM)
            hits, items = b.column("hit").to_pylist(), b.column("items").to_pylist()
            for i in range(b.num_rows):
                n = int(at[i + 1] - at[i])
                win, start = index.value.find(h[at[i] : at[i + 1]])
                if len(win):
                    edge = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + index.value.size[win], -1)
                    bits = np.packbits(np.cumsum(edge[:-1]) > 0)
                    hits[i] = (bits if hits[i] is None else bits | np.frombuffer(hits[i], np.uint8)).tobytes()
                    items[i] = sorted({*items[i], *(x for w in np.unique(win) for x in index.value.items[w])})
            columns = {"row": b.column("row"), "t": b.column("t"), "hit": pa.array(hits, pa.binary()), "items": pa.array(items, pa.list_(pa.string())), "n_words": pa.array(np.diff(at))}
            yield pa.RecordBatch.from_arrays([columns[c] for c in b.schema.names], b.schema.names)

    return mark


def _summary(batches):
    for b in batches:
        hit = [0 if x is None else int(np.unpackbits(np.frombuffer(x, np.uint8)).sum()) for x in b.column("hit").to_pylist()]
        items = b.column("items").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [
                b.column("row"),
                b.column("n_words"),
                pa.array(hit, pa.int64()),
                pa.array([len(x) for x in items], pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
                pa.array([n > 0 for n in hit], pa.bool_()),
            ],
            ["row", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return contamination(docs, bench).drop("text")
