"""Nearest neighbours by randomly rotated one-bit codes with error bounds.

Index. Vectors are centred on their mean, scaled to unit length and turned by one random rotation; the signs are
the code (one bit a dimension, packed), kept with two correction scalars: the length of the centred vector and
the inner product of the code with it. Search. The inner product of a rotated query with a vector is estimated
from the packed bits and the scalars; its error is below EPSILON / sqrt(dim - 1) * sqrt(1 - ip^2) / ip but for a
vanishing share (Gao and Long, "RaBitQ"). The k best by estimate are measured exactly; every vector whose lower
bound reaches below the k-th distance so found is then measured too. Distances are exact on original vectors.

Plan. Vectors are dealt by hash into blocks of bounded size, queries likewise; a query block meets every index
block in one equi-join on the block number, and yields k rows a query and block; one window keeps the k best.
There is no bucket to overflow, so repeated vectors make no hot block. Each dimension is a space of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexilake.llm.common import Workspace

EPSILON = 3.0
BLOCK, QUERY_BLOCK = 4096, 512


def usable(column: str) -> Column:
    """Not null or empty, every component finite, some component not zero."""
    x = F.col(column)
    fine = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(x) > 0) & fine & F.exists(x, lambda v: v != 0), F.lit(False))


def rotation(dim: int, seed: int = 17) -> np.ndarray:
    """A random orthogonal matrix, the same on every machine."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64([seed, dim])).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


class Codes:
    """One-bit codes of some vectors (rows of a float64 matrix)."""

    def __init__(self, vectors: np.ndarray, mean: np.ndarray, turn: np.ndarray):
        centred = vectors - mean
        self.length = np.sqrt((centred**2).sum(1))
        turned = (centred / np.maximum(self.length, 1e-300)[:, None]) @ turn
        self.bits = np.packbits(turned > 0, axis=1, bitorder="little")
        #: inner product of code and vector, both of unit length; 0 where the vector is the mean
        self.ip = np.abs(turned).sum(1) / np.sqrt(vectors.shape[1])
        self.dim = vectors.shape[1]

    def estimate(self, query: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(estimated squared distance of the query to each vector, bound of its error)."""
        centred = query - mean
        far = float(np.sqrt((centred**2).sum()))
        q = (centred / max(far, 1e-300)) @ turn
        # sum of the query over set bits, from tables of a byte's 256 patterns
        padded = np.concatenate([q, np.zeros(-len(q) % 8)]).reshape(-1, 8)
        table = padded @ _PATTERNS
        over = table[np.arange(len(padded))[None, :], self.bits].sum(1)
        code = (2 * over - q.sum()) / np.sqrt(self.dim)
        ip = np.maximum(self.ip, 1e-12)
        error = EPSILON * np.sqrt(np.maximum(0, 1 - ip**2)) / ip / np.sqrt(max(1, self.dim - 1))
        scale = 2 * self.length * far
        return self.length**2 + far**2 - scale * code / ip, np.where(self.length > 0, scale * error, 0) + 1e-9 * (self.length**2 + far**2)


_PATTERNS = ((np.arange(256)[None, :] >> np.arange(8)[:, None]) & 1).astype(np.float64)


def distances(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, summed dimension by dimension."""
    total = np.zeros(len(vectors))
    for j in range(len(query)):
        d = vectors[:, j] - query[j]
        total += d * d
    return np.sqrt(total)


def _nearest(codes: Codes, ids: np.ndarray, vectors: np.ndarray, own: int, query: np.ndarray, mean: np.ndarray, turn: np.ndarray, k: int):
    """(ids, distances) of the k nearest of a block to one query, but for the query's own id; ties to the smaller id."""
    about, error = codes.estimate(query, mean, turn)
    other = ids != own
    about = np.where(other, about, np.inf)
    first = np.argpartition(about, min(k, len(ids)) - 1)[:k]
    first = first[other[first]]
    if not len(first):
        return ids[:0], np.empty(0)
    limit = distances(query, vectors[first]).max() ** 2 if len(first) == k else np.inf
    rows = np.flatnonzero(other & (about - error <= limit * (1 + 1e-12)))
    d = distances(query, vectors[rows])
    best = np.lexsort((ids[rows], d))[:k]
    return ids[rows][best], d[best]


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score for the k nearest of vectors to each row of queries.

    Nearness is Euclidean; ties go to the smaller id, and a query's own id is no candidate. Vectors that are null,
    empty or zero, or hold a null or non-finite component, and null ids, take no part on either side. A vector is
    compared with those of its own dimension only. Rows that repeat an id and vector count once.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "ann")
    pick = lambda df: df.where(usable(column) & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v")).distinct()
    index, asked = pick(vectors), pick(queries)
    dims = vectors.where(usable(column)).groupBy(F.size(column).alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()
    means = {}
    for r in dims:
        of = vectors.where(usable(column) & (F.size(column) == r.dim)).select(F.posexplode(F.col(column).cast("array<double>")).alias("j", "x"))
        means[r.dim] = np.array([m.x for m in of.groupBy("j").agg(F.avg("x").alias("x")).orderBy("j").collect()])
    blocks = {r.dim: max(1, -(-r.n // BLOCK)) for r in dims}
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    known = spark.createDataFrame([(d, n) for d, n in blocks.items()], "dim int, blocks int")
    dealt = index.withColumn("dim", F.size("v")).join(F.broadcast(known), "dim").select("dim", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "id", "v")
    query_blocks = -(-max(1, asked.count()) // QUERY_BLOCK)

    def pack(t: pa.Table) -> pa.Table:
        ids, flat = t.column("id").to_numpy(), t.column("v").combine_chunks().flatten().to_numpy()
        return pa.table({"dim": t.column("dim")[:1], "block": t.column("block")[:1], "ids": pa.array([ids.tobytes()], pa.binary()), "vs": pa.array([flat.tobytes()], pa.binary())})

    shape = "dim int, block int, ids binary, vs binary"
    packed = work.save(dealt.groupBy("dim", "block").applyInArrow(pack, shape))
    part = asked.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("id", F.lit(5)), F.lit(query_blocks)).cast("int").alias("block"), "id", "v")
    ask = part.groupBy("dim", "block").applyInArrow(pack, shape).join(F.broadcast(known), "dim").select("dim", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("ids").alias("q_ids"), F.col("vs").alias("q_vs"))
    pairs = packed.join(ask, ["dim", "block"]).repartition(max(16, sum(blocks.values()) * query_blocks // 4), "dim", "block", F.xxhash64("q_ids"))

    def search(batches):
        for b in batches:
            for row in b.to_pylist():
                dim = row["dim"]
                mean, turn = means[dim], rotation(dim)
                ids, vs = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vs"]).reshape(-1, dim)
                codes = Codes(vs, mean, turn)
                out = [(int(q), *_nearest(codes, ids, vs, int(q), v, mean, turn, k)) for q, v in zip(np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["q_vs"]).reshape(-1, dim), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([o[0] for o in out], [len(o[1]) for o in out]).astype(np.int64)), pa.array(np.concatenate([o[1] for o in out]).astype(np.int64)), pa.array(np.concatenate([o[2] for o in out]))],
                    ["query_id", "vec_id", "score"],
                )

    found = pairs.mapInArrow(search, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest_neighbours(vectors, vectors.where("vec_id % 100 = 0"))


ANN_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), d AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
