"""Toxicity scores from subword-bag embeddings averaged into a linear softmax, trained in numpy.

A text is the bag of its distinct words' features: the word and its character 4- and 5-grams (with < and > at the
ends), hashed into 2^BITS embeddings, and PADDING features whose embedding is zero, so that a few words or one word
repeated weigh little. Their average goes into a softmax over the two classes; embeddings and softmax
are trained jointly by Adagrad on cross entropy. A misspelling or an unseen ending shares most n-grams with the
words seen. Since average and softmax's logit difference are linear, each feature's share of a score is one
number, embedding times weight difference, so scoring broadcasts one float a feature (2^BITS * 4 bytes).

Training takes a bounded sample of the labelled rows: sample_size (SAMPLE by default) of either class at most, those
with the least hash of their id. Scores are corrected to the classes' shares among all labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexilake.llm.common import bounded_batches, crc32_mod, give_back, released
from lexilake.llm.wordhash import U64, mix

BITS, WIDTH, GRAMS = 18, 8, (4, 5)
SAMPLE, EPOCHS, BATCH, RATE, DAMPING = 3000, 12, 64, 1.0, 0.1
PADDING = 300
THRESHOLD = 0.3
_rng = np.random.Generator(np.random.PCG64(11))
_SLOT = _rng.integers(1, 2**63, 64, dtype=np.uint64) | U64(1)
_WORD = int(_rng.integers(1, 2**62)) | 1
_LESS, _MORE = 0x110001, 0x110002
CHUNK = 1 << 20


def _code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of all texts' words in order, each word's length, words of each text), lower-cased."""
    words = [(t or "").lower().split() for t in texts]
    flat = [w for x in words for w in x]
    codes = np.frombuffer("".join(flat).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    return codes, np.fromiter(map(len, flat), np.int64, len(flat)), np.fromiter(map(len, words), np.int64, len(words))


def _features(codes: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature of each word's n-grams and of itself, number of features of each word), grouped by word."""
    n = len(lens)
    if not n:
        return np.empty(0, np.int64), lens
    first = np.cumsum(lens) - lens
    # < word >
    at = first + 2 * np.arange(n)
    full = np.zeros(len(codes) + 2 * n, dtype=np.uint64)
    full[at], full[at + lens + 1] = _LESS, _MORE
    inner = np.ones(len(full), dtype=bool)
    inner[at] = inner[at + lens + 1] = False
    full[inner] = codes
    size = lens + 2
    owner = np.repeat(np.arange(n), size)
    left = size[owner] - (np.arange(len(full)) - at[owner])
    ids, who = [_whole(full, at, left), ], [np.arange(n)]
    for g in GRAMS:
        h = np.zeros(max(0, len(full) - g + 1), dtype=np.uint64)
        for j in range(g):
            h += mix(full[j : j + len(h)] + U64(j << 32)) * _SLOT[j]
        ok = np.flatnonzero(left[: len(h)] >= g)
        ids.append(mix(h[ok] + U64(g)))
        who.append(owner[ok])
    ids, who = np.concatenate(ids), np.concatenate(who)
    order = np.argsort(who, kind="stable")
    return (ids[order] >> U64(64 - BITS)).astype(np.int64), np.bincount(who, minlength=n)


def _whole(full: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    v = mix(full + (left.astype(np.uint64) << U64(32))) * U64(_WORD)
    return mix(np.add.reduceat(v, at))


def _unique_words(texts: list[str | None]):
    """(features and their number for each distinct word, word of each running word, words of each text)."""
    codes, lens, per_text = _code_points(texts)
    if not len(lens):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), per_text
    first = np.cumsum(lens) - lens
    left = np.repeat(lens, lens) - (np.arange(len(codes)) - np.repeat(first, lens))
    h = _whole(codes, first, left)
    _, one, back = np.unique(h, return_index=True, return_inverse=True)
    take = np.repeat(first[one], lens[one]) + np.arange(lens[one].sum()) - np.repeat(np.cumsum(lens[one]) - lens[one], lens[one])
    ids, n = _features(codes[take], lens[one])
    return ids, n, back, per_text


def _chunks(texts: list[str | None]):
    """Indexes of texts in groups of about CHUNK characters."""
    a, room = 0, 0
    for i, t in enumerate(texts):
        room += len(t or "")
        if room > CHUNK:
            yield a, i + 1
            a, room = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def train(texts: list[str | None], toxic: np.ndarray, seed: int = 3) -> tuple[np.ndarray, float]:
    """(share of each feature in the logit, bias) of a model trained on these whole texts."""
    rows = []
    for a, z in _chunks(texts):
        ids, n, back, per_text = _unique_words(texts[a:z])
        at, end = np.cumsum(n) - n, np.cumsum(per_text)
        for i in range(z - a):
            words = np.unique(back[end[i] - per_text[i] : end[i]])
            own = n[words]
            rows.append(ids[np.repeat(at[words], own) + np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)].astype(np.int32))
    share = 1 / (PADDING + np.array([len(r) for r in rows], dtype=np.float64))
    rng = np.random.Generator(np.random.PCG64(seed))
    emb = rng.normal(0, 0.01, (1 << BITS, WIDTH)).astype(np.float32)
    soft = rng.normal(0, 0.5, (2, WIDTH)).astype(np.float32)
    bias = np.zeros(2)
    g_emb, g_soft, g_bias = np.full(1 << BITS, DAMPING, np.float32), np.full(WIDTH, 1e-8), 1e-8
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(rows))
        for a in range(0, len(order), BATCH):
            some = order[a : a + BATCH]
            ids, who = np.concatenate([rows[i] for i in some]), np.repeat(np.arange(len(some)), [len(rows[i]) for i in some])
            u = soft[1] - soft[0]
            logit = np.bincount(who, (emb @ u)[ids], len(some)) * share[some] + bias[1] - bias[0]
            # the cross entropy's slope by the logit of class 1; that of class 0 is its negative
            slope = 1 / (1 + np.exp(-np.clip(logit, -60, 60))) - toxic[some]
            pull = np.bincount(ids, (slope * share[some])[who], 1 << BITS).astype(np.float32)
            to_soft, to_bias = pull @ emb, slope.sum()
            g_emb += pull * pull * np.float32((u @ u) / WIDTH)
            emb -= (np.float32(rate) * pull / np.sqrt(g_emb))[:, None] * u[None, :]
            g_soft += to_soft**2
            g_bias += to_bias**2
            soft += np.outer([1, -1], rate * to_soft / np.sqrt(g_soft)).astype(np.float32)
            bias += np.array([1, -1]) * rate * to_bias / np.sqrt(g_bias)
    return (emb @ (soft[1] - soft[0])).astype(np.float32), float(bias[1] - bias[0])


def score_texts(texts: list[str | None], share: np.ndarray, bias: float) -> np.ndarray:
    """Logit of each whole text; an empty text has the bias."""
    out = np.full(len(texts), bias, dtype=np.float64)
    for a, z in _chunks(texts):
        ids, n, back, per_text = _unique_words(texts[a:z])
        if not len(n):
            continue
        sums = np.add.reduceat(share[ids].astype(np.float64), np.cumsum(n) - n)
        pairs = np.unique(np.repeat(np.arange(z - a), per_text) * len(n) + back)  # the distinct words of each text
        who, word = pairs // len(n), pairs % len(n)
        out[a:z] += np.bincount(who, sums[word], z - a) / (PADDING + np.bincount(who, n[word], z - a))
    return out


def learn(docs: DataFrame, labels: DataFrame, usable=None, sample_size: int | None = SAMPLE) -> tuple[np.ndarray, float]:
    """A model from docs(doc_id, text) and labels(doc_id, toxic), over the labelled rows that usable allows.

    sample_size: rows of either class at most, those of least hash; None takes all, in one task. An id with more than
    one label counts as toxic if any says so; of several texts of an id the least is taken. With labels of one class only, or none, every
    score is that class's smoothed share.
    """
    spark = docs.sparkSession
    lab = labels.where("doc_id is not null and toxic is not null")
    if usable is not None:
        lab = lab.where(usable)
    lab = lab.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r.toxic: r.n for r in lab.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    prior = float(np.log((n1 + 1) / (n0 + 1)))
    flat = np.zeros(1 << BITS, np.float32)
    if not n1 or not n0:
        return flat, prior
    h = F.xxhash64("doc_id", F.lit(9))
    if sample_size is None:
        sample = lab
    else:
        one, none = (lab.where(F.col("toxic") == y).orderBy(h, "doc_id").limit(sample_size) for y in (1, 0))
        sample = F.broadcast(one.unionByName(none))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = texts.join(sample, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def fit(batches):
        rows = sorted((d, t, y) for b in batches for d, t, y in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "toxic")), strict=True))
        y = np.array([r[2] for r in rows], dtype=np.int64)
        if len(set(y.tolist())) < 2:
            return
        share, bias = train([r[1] for r in rows], y)
        yield pa.RecordBatch.from_arrays([pa.array([share.tobytes()], pa.binary()), pa.array([bias]), pa.array([int(y.sum())]), pa.array([len(y)])], ["share", "bias", "n1", "n"])

    got = chosen.select("doc_id", "text", "toxic").repartition(1).mapInArrow(released(fit), "share binary, bias double, n1 long, n long").collect()
    if not got:
        return flat, prior
    m = got[0]
    return np.frombuffer(m.share, np.float32), m.bias + prior - float(np.log(m.n1 / (m.n - m.n1)))


def score(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= threshold, else 0) appended; null texts are empty."""
    spark = docs.sparkSession
    bounded_batches(spark)
    known = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(1 / (1 + np.exp(-np.clip(score_texts(texts.tolist(), *known.value), -500, 500))))
        give_back()

    return docs.withColumn("score", toxic(F.coalesce(F.col("text").cast("string"), F.lit("")))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


HELD_OUT = 2


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = learn(docs, labels, crc32_mod("doc_id", 4) != HELD_OUT)
    return score(docs, model).select("doc_id", (crc32_mod("doc_id", 4) == HELD_OUT).alias("held_out"), "score", "predicted")
