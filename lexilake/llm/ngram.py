"""Document log-probabilities by deleted interpolation of n-gram estimates.

P(w | h) = a(b) P0(w) + sum over k of l_k(b) c(h_k w) / c(h_k): P0 adds 0.1 to every unigram count and to one
unknown word; h_k are the last k words. The weights depend on b, the bucket of the frequency of the longest
context seen: a power of two. They are learned by expectation-maximisation on held-out counts: of the learning
documents, those of one residue are held out, and the estimates that they are shown come from the others' counts.
A document starts after one start symbol and ends in an end token; n-grams do not reach across documents.

Plan. One pass over the texts writes packed batches: the word hashes, numbered within the batch, of about
BATCH_TOKENS tokens. From those each batch asks for its distinct n-grams, sorted and split by hash; a partition
adds up the counts of all batches and answers each with one number an n-gram. Both ways n-grams travel as
compressed binary columns, a few bytes each, and a frequent n-gram costs one entry a batch, so no key is hot.
Nothing of the corpus is broadcast; the driver sees totals by partition and a histogram of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexilake.llm import wordhash as W
from lexilake.llm.common import Workspace, bounded_batches, crc32_mod, partitions, released
from lexilake.llm.wordhash import U64

ORDER = 3
BATCH_TOKENS = 2_000_000
PART_TOKENS = 4_000_000  # learning tokens to a part of the hashes, which one task holds
AT_ONCE = 500_000  # n-grams of a part that are counted together
BUCKETS = 24
STEP = 1  # to an octave, in the cells for expectation-maximisation
ROUNDS = 30
FOLDS, HELD_OUT, TUNING = 10, 0, 1
_START, _END = U64(0x5354415254), U64(0x454E44)
_TIMES = [U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9)]


def _pack(x: np.ndarray) -> bytes:
    """Compressed little-endian integers: byte planes, so that high zero bytes cost nothing."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(data: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(dtype.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def _by_count(count: np.ndarray) -> np.ndarray:
    """Order of a batch's words: frequent ones first, so that most numbers are small."""
    return np.argsort(-count.astype(np.int64), kind="stable")


def _texts_to_batches(batches):
    """(tuning, doc ids, fold of each, tokens of each, distinct word hashes, their counts, word numbers) as packed rows."""
    held: dict[bool, list] = {False: [], True: []}

    def row(tuning):
        ids, folds, sizes, words = zip(*held[tuning], strict=True)
        held[tuning] = []
        known, number, count = np.unique(np.concatenate(words), return_inverse=True, return_counts=True)
        rank = np.empty(len(known), np.uint32)
        rank[_by_count(count)] = np.arange(len(known), dtype=np.uint32)
        steps, counts = _pack(np.diff(known, prepend=U64(0))), _pack(count.astype(np.uint32))
        return [tuning, pa.array(ids, pa.int64()), list(map(int, folds)), list(map(int, sizes)), steps, counts, _pack(rank[number])]

    def out(rows):
        types = [pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], ["tuning", "ids", "folds", "sizes", "known", "counts", "numbers"])

    room = {False: 0, True: 0}
    for b in batches:
        ids, folds = b.column(0).to_pylist(), b.column(2).to_pylist()
        h, at = W.hash_texts(W.utf8(b.column(1)), W.SPACED)
        for i, (doc, fold) in enumerate(zip(ids, folds, strict=True)):
            tuning = fold == TUNING
            held[tuning].append((doc, fold, at[i + 1] - at[i] + 1, np.append(h[at[i] : at[i + 1]], _END)))
            room[tuning] += at[i + 1] - at[i] + 1
            if room[tuning] > BATCH_TOKENS:
                yield out([row(tuning)])
                room[tuning] = 0
    for tuning in (False, True):
        if held[tuning]:
            yield out([row(tuning)])


class _Tokens:
    """The tokens of one batch, unpacked, and their n-grams."""

    def __init__(self, folds, sizes, known: bytes, counts: bytes, numbers: bytes):
        self.sizes = np.asarray(sizes, np.int64)
        self.known = np.cumsum(_unpack(known, np.uint64), dtype=np.uint64)[_by_count(_unpack(counts, np.uint32))]
        self.number = _unpack(numbers, np.uint32)
        self.fold = np.repeat(np.asarray(folds, np.int8), self.sizes)
        first = np.cumsum(self.sizes) - self.sizes
        self.place = (np.arange(len(self.number)) - np.repeat(first, self.sizes)).astype(np.int32)

    def _hashes(self, n: int) -> np.ndarray:
        """Hash of the n-gram that ends in each token, n > 1; 0 where it would start before the start symbol."""
        h = (self.known * _TIMES[0])[self.number]
        for k in range(1, n):
            back = np.roll((W.mix(self.known + U64(k)) * _TIMES[k])[self.number], k)  # the word k places before
            back[self.place == k - 1] = W.mix(np.array([_START + U64(k)])) * _TIMES[k]
            h += back
        h = W.mix(h + U64(n))
        h[self.place < n - 2] = 0
        return h

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(sorted hashes of the batch's distinct n-grams, number of each token's among them). Hash 0 is no n-gram."""
        if n > 1:
            return np.unique(self._hashes(n), return_inverse=True)
        h = W.mix(self.known * _TIMES[0] + U64(1))
        order = np.argsort(h)
        place = np.empty(len(h), np.int64)
        place[order] = np.arange(len(h))
        return h[order], place[self.number]


def _cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part begins among sorted n-gram hashes: parts are ranges of equal width."""
    return np.searchsorted((keys >> U64(32)) * U64(parts) >> U64(32), np.arange(parts + 1).astype(np.uint64))


def _requests(order: int, parts: int):
    """Distinct n-grams of each batch with their counts in learning and tuning documents, split by hash."""

    def run(batches):
        for b in batches:
            for batch, *own in zip(*(b.column(c).to_pylist() for c in ("batch", "folds", "sizes", "known", "counts", "numbers")), strict=True):
                t = _Tokens(*own)
                learn, tune = t.fold != HELD_OUT, t.fold == TUNING
                rows = []
                for n in range(1, order + 1):
                    keys, number = t.grams(n)
                    total = np.bincount(number[learn], minlength=len(keys)).astype(np.uint32)
                    tuned = np.bincount(number[tune], minlength=len(keys)).astype(np.uint32) if tune.any() else np.zeros(len(keys), np.uint32)
                    if len(keys) and not keys[0]:
                        total[0] = tuned[0] = 0
                    cut = _cuts(keys, parts)
                    for p in np.flatnonzero(np.diff(cut)):
                        own = slice(cut[p], cut[p + 1])
                        step = np.diff(keys[own], prepend=U64(0))
                        rows.append((n, int(p), batch, _pack(step), _pack(total[own]), _pack(tuned[own]) if tune.any() else b""))
                    starts = int((learn & (t.place == 0)).sum()), int((tune & (t.place == 0)).sum())
                rows.append((0, 0, batch, b"", *(int(x).to_bytes(8, "little") for x in starts)))
                for a in range(0, len(rows), 64):
                    cols = list(zip(*rows[a : a + 64], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, (pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["n", "part", "batch", "keys", "total", "tuned"])

    return run


def _answers(table: pa.Table) -> pa.Table:
    """Counts over all batches for every n-gram that a batch of this partition asked for."""
    n, part = table.column("n")[0].as_py(), table.column("part")[0].as_py()
    rows = table.select(["batch", "keys", "total", "tuned"]).to_pylist()
    if n == 0:
        sums = [sum(int.from_bytes(r[c], "little") for r in rows) for c in ("total", "tuned")]
        return pa.table({"n": pa.array([0], pa.int32()), "part": pa.array([0], pa.int32()), "batch": [""], "total": pa.array([b""], pa.binary()), "tuned": pa.array([b""], pa.binary()), "types": [0], "tokens": [sums[0]], "tuning_types": [0], "tuning_tokens": [sums[1]]})
    keys = [np.cumsum(_unpack(r["keys"], np.uint64), dtype=np.uint64) for r in rows]
    total = [_unpack(r["total"], np.uint32).astype(np.uint64) for r in rows]
    tuned = [_unpack(r["tuned"], np.uint32).astype(np.uint64) if r["tuned"] else np.zeros(len(k), np.uint64) for r, k in zip(rows, keys, strict=True)]
    # the part in narrower ranges of hashes, so that sorting takes little beside the keys
    low, high = min(k[0] for k in keys), max(k[-1] for k in keys)
    ranges = max(1, sum(map(len, keys)) // AT_ONCE)
    cuts = np.array([int(low) + (int(high) - int(low)) * j // ranges for j in range(1, ranges)], np.uint64)
    at = [[0, *np.searchsorted(k, cuts).tolist(), len(k)] for k in keys]
    sums = np.zeros(4, np.int64)
    for j in range(ranges):
        own = [slice(x[j], x[j + 1]) for x in at]
        known, back = np.unique(np.concatenate([k[x] for k, x in zip(keys, own, strict=True)]), return_inverse=True)
        t, u = (np.bincount(back, np.concatenate([v[x] for v, x in zip(c, own, strict=True)]), len(known)).astype(np.uint64) for c in (total, tuned))
        sums += [int((t > 0).sum()), int(t.sum()), int((t > u).sum()), int((t - u).sum())]
        z = 0
        for k, x in enumerate(own):
            a, z = z, z + x.stop - x.start
            total[k][x], tuned[k][x] = t[back[a:z]], u[back[a:z]]
    m = len(rows)
    once = lambda v: [int(v)] + [0] * (m - 1)
    return pa.table(
        {
            "n": pa.array([n] * m, pa.int32()),
            "part": pa.array([part] * m, pa.int32()),
            "batch": [r["batch"] for r in rows],
            "total": pa.array(map(_pack, total), pa.binary()),
            # only batches of tuning documents are told of the others
            "tuned": pa.array([_pack(u) if r["tuned"] else b"" for u, r in zip(tuned, rows, strict=True)], pa.binary()),
            "types": once(sums[0]),
            "tokens": once(sums[1]),
            "tuning_types": once(sums[2]),
            "tuning_tokens": once(sums[3]),
        }
    )


class _Counts:
    """Per token of a batch: counts of its n-grams and of their contexts, from the answers."""

    def __init__(self, batch: dict, answers: list[dict], order: int, parts: int, starts: int, tuning: bool):
        self.t = t = _Tokens(*(batch[c] for c in ("folds", "sizes", "known", "counts", "numbers")))
        self.gram, self.context = [], []
        for n in range(1, order + 1):
            keys, number = t.grams(n)
            count = np.zeros(len(keys), np.int64)
            cut = _cuts(keys, parts)
            for a in answers:
                if a["n"] == n:
                    c = _unpack(a["total"], np.int64)
                    count[cut[a["part"]] : cut[a["part"] + 1]] = c - _unpack(a["tuned"], np.int64) if tuning else c
            self.gram.append(count[number])
            if n < order:
                # a context is the n-gram that ends before the token; before the first stands the start symbol
                c = np.roll(self.gram[-1], 1)
                c[t.place == 0] = starts if n == 1 else 0
                self.context.append(c)

    def parts(self, n_tokens: int, n_types: int) -> tuple[np.ndarray, np.ndarray]:
        """(bucket of each token, its probability under each component)."""
        p = [(self.gram[0] + 0.1) / (n_tokens + 0.1 * (n_types + 1))]
        bucket = np.zeros(len(p[0]), np.int64)
        for k, c in enumerate(self.context):
            seen = c > 0
            p.append(np.where(seen, self.gram[k + 1] / np.maximum(c, 1), 0.0))
            level = np.minimum(np.frexp(np.maximum(c, 1))[1], BUCKETS)
            bucket = np.where(seen, 1 + k * BUCKETS + level - 1, bucket)
        return bucket, np.stack(p, 1)


def _histogram(order: int, parts: int, starts: int, n_tokens: int, n_types: int):
    """Tuning tokens by bucket and rounded component probabilities, with the sums of the probabilities themselves."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        answers, out = right.select(["n", "part", "total", "tuned"]).to_pylist(), []
        for batch in left.to_pylist():
            bucket, p = _Counts(batch, answers, order, parts, starts, True).parts(n_tokens, n_types)
            with np.errstate(divide="ignore"):
                grid = np.where(p > 0, np.round(np.log2(p) * STEP), -1000).astype(np.int64)
            code = bucket
            for k in range(order):
                code = code * 4096 + grid[:, k] + 2048
            cells, back, n = np.unique(code, return_inverse=True, return_counts=True)
            out.append(pa.table({"cell": cells, "n": n} | {f"p{k}": np.bincount(back, p[:, k], len(cells)) for k in range(order)}))
        return pa.concat_tables(out)

    return run


def learn_weights(bucket: np.ndarray, p: np.ndarray, n: np.ndarray, size: int, rounds: int = ROUNDS) -> np.ndarray:
    """Mixture weights of each bucket by expectation-maximisation; a bucket without tokens takes its neighbour's."""
    comps = p.shape[1]
    usable = np.zeros((size, comps), bool)
    usable[:, 0] = True
    for b in range(1, size):
        usable[b, 1 : 1 + (b - 1) // BUCKETS + 1] = True
    weights = usable / usable.sum(1, keepdims=True)
    mass = np.bincount(bucket, n, size)
    for _ in range(rounds):
        each = weights[bucket] * p
        each *= (n / np.maximum(each.sum(1), 1e-300))[:, None]
        new = np.stack([np.bincount(bucket, each[:, k], size) for k in range(comps)], 1)
        # one token's worth of the even mixture keeps every weight above zero
        weights = (new + usable / usable.sum(1, keepdims=True)) / (mass + 1)[:, None]
    for b in range(1, size):
        if not mass[b] and (b - 1) % BUCKETS and mass[b - 1]:
            weights[b], mass[b] = weights[b - 1], mass[b - 1]
    return weights


def _scores(order: int, parts: int, starts: int, n_tokens: int, n_types: int, weights: np.ndarray):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        answers, out = right.select(["n", "part", "total", "tuned"]).to_pylist(), []
        for batch in left.to_pylist():
            c = _Counts(batch, answers, order, parts, starts, False)
            bucket, p = c.parts(n_tokens, n_types)
            sizes = c.t.sizes
            first = np.cumsum(sizes) - sizes
            add = lambda x: np.add.reduceat(x, first) if len(first) else x[:0]  # noqa: E731, B023
            out.append(
                pa.table(
                    {
                        "doc_id": pa.array(batch["ids"], pa.int64()),
                        "held_out": np.asarray(batch["folds"], np.int64) == HELD_OUT,
                        "n_tokens": sizes,
                        "n_known": add((c.gram[0] > 0).astype(np.int64)),
                        "train_tokens": np.full(len(sizes), n_tokens),
                        "base_score": add(np.log10(p[:, 0])),
                        "score": add(np.log10((weights[bucket] * p).sum(1))),
                    }
                )
            )
        return pa.concat_tables(out) if out else SCORES.empty_table()

    return run


SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def language_model_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents whose crc32(doc_id) mod 10 is HELD_OUT are not learned from; of the others those of TUNING set the
    mixture weights. A null text is empty (its only token is the end); a null doc_id counts as the empty id.
    Without learning documents every word is unknown. Scores are log10.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    work = Workspace(spark, "ngram")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), crc32_mod("doc_id", FOLDS).cast("int").alias("fold"))
    packed = rows.mapInArrow(released(_texts_to_batches), "tuning boolean, ids array<long>, folds array<int>, sizes array<long>, known binary, counts binary, numbers binary")
    batches = work.save(packed.withColumn("batch", F.concat_ws("-", F.spark_partition_id(), F.monotonically_increasing_id())))
    size = batches.select(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda x, y: x + y)), F.lit(0)).alias("tokens")).first()
    parts = max(16, -(-size.tokens // PART_TOKENS))
    tasks = lambda rows: max(partitions(spark), int(rows))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    asked = batches.select("batch", "folds", "sizes", "known", "counts", "numbers").mapInArrow(released(_requests(order, parts)), "n int, part int, batch string, keys binary, total binary, tuned binary")
    answers = work.save(asked.repartition(tasks(3 * parts), "n", "part").groupBy("n", "part").applyInArrow(_answers, "n int, part int, batch string, total binary, tuned binary, types long, tokens long, tuning_types long, tuning_tokens long"))
    sums = {r.n: r for r in answers.groupBy("n").agg(*(F.sum(c).alias(c) for c in ("types", "tokens", "tuning_types", "tuning_tokens"))).collect()}
    if 1 not in sums:
        return spark.createDataFrame([], "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    starts, tuning_starts = sums[0].tokens, sums[0].tokens - sums[0].tuning_tokens
    both = batches.select("batch", "tuning", "ids", "folds", "sizes", "known", "counts", "numbers")
    replies = answers.where("n > 0").select("batch", "n", "part", "total", "tuned")

    tuning = both.where("tuning")
    own = replies.join(tuning.select("batch"), "batch", "left_semi")
    cells = tuning.groupBy("batch").cogroup(own.groupBy("batch")).applyInArrow(
        _histogram(order, parts, tuning_starts, sums[1].tuning_tokens, sums[1].tuning_types), "cell long, n long, " + ", ".join(f"p{k} double" for k in range(order))
    )
    # a cell stands for its mean probabilities; there are some thousands of cells, whatever the input
    seen = cells.groupBy("cell").agg(F.sum("n").alias("n"), *(F.sum(f"p{k}").alias(f"p{k}") for k in range(order))).orderBy("cell").toArrow()
    n = seen["n"].to_numpy().astype(np.float64)
    means = np.stack([seen[f"p{k}"].to_numpy() for k in range(order)], 1) / n[:, None]
    weights = learn_weights(seen["cell"].to_numpy() >> (12 * order), means, n, 1 + (order - 1) * BUCKETS)

    dealt = lambda df: df.repartition(tasks(size.n / 4), "batch").groupBy("batch")
    return dealt(both).cogroup(dealt(replies)).applyInArrow(
        _scores(order, parts, starts, sums[1].tokens, sums[1].types, weights),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
