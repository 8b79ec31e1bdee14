"""Exact top-k by inner product, filtered by multi-resolution segment statistics.

A vector is split into segments; with each segment's mean m and deviation s (root of the summed squared
deviations), |q - x|^2 is at least the sum over segments of n (m_q - m_x)^2 + (s_q - s_x)^2. With the two
norms this lower bound of the distance is an upper bound of the inner product. Bounds go from coarse to
fine; a pair that can't reach the query's k-th score found so far is dropped; survivors get their exact
integer product. Queries go out in blocks of a fixed number; each block meets all rows in one pass.

Components become floor(scale * x) as integers. Vectors that are null, or hold a null, NaN or infinite
component, take no part; nor do those of another length than the block's. A query never meets its own row
(equal id). Ties go to the smaller id; repeated rows count each. Empty tables give an empty result.
Large components count like any other: products that could pass 2^62 are summed as wide integers. A scaled
component or a score met on the way to the best that is no 64-bit integer is an error, never left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import cut, map_text

SCALE, TOP = 1024, 10
#: Below every score.
EMPTY = -(1 << 63)
#: Segments at each resolution; queries in one block; rows met at once.
RESOLUTIONS, QUERY_BLOCK, ROWS = (4, 16), 8192, 2048


def statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Scaled means and deviations: root(n) m and s for each segment, so bounds are plain squared distances."""
    cuts = np.array_split(np.arange(x.shape[1]), segments)
    mean = np.stack([x[:, c].mean(1) for c in cuts], 1)
    dev = np.stack([np.sqrt(((x[:, c] - x[:, c].mean(1, keepdims=True)) ** 2).sum(1)) for c in cuts], 1)
    return mean * np.sqrt([len(c) for c in cuts]), dev


def _products(q: np.ndarray, x: np.ndarray, q_norm: np.ndarray, x_norm: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows; norms are the squared ones, whose product bounds all partial sums."""
    s = np.einsum("ij,ij->i", q, x)
    for i in np.flatnonzero(np.sqrt(q_norm) * np.sqrt(x_norm) >= 2.0**62).tolist():
        wide = sum(a * b for a, b in zip(q[i].tolist(), x[i].tolist()))
        if not EMPTY < wide < 1 << 63:
            raise OverflowError(f"an inner product of {wide} is outside the range of scores")
        s[i] = wide
    return s


class Block:
    """A block of queries and each one's best k so far."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.stats = [np.hstack(statistics(q.astype(float), min(s, q.shape[1]))) for s in RESOLUTIONS]
        self.norm = (q.astype(float) ** 2).sum(1)
        self.score = np.full((len(q), k), EMPTY)
        self.vec = np.full((len(q), k), np.iinfo(np.int64).max)

    def meet(self, vec: np.ndarray, x: np.ndarray) -> None:
        """Rows of integers, at most a few thousand, meet all queries."""
        own = [np.hstack(statistics(x.astype(float), min(s, x.shape[1]))) for s in RESOLUTIONS]
        norm = (x.astype(float) ** 2).sum(1)
        for lo in range(0, len(self.q), 256):
            hi = min(lo + 256, len(self.q))
            part = slice(lo, hi)
            # |q - x|^2 >= |stat_q - stat_x|^2 and |stat|^2 = |x|^2, so the product is at most stat_q . stat_x
            bound = self.stats[0][part] @ own[0].T
            slack = 1e-6 * np.sqrt(self.norm[part][:, None] * norm[None, :]) + 1e-3
            bound += slack
            bound[self.ids[part][:, None] == vec[None, :]] = -np.inf
            if (self.score[part, -1] == EMPTY).any():  # first rows: exact products of the most promising
                n = min(2 * self.k, len(x))
                top = np.argpartition(-bound, n - 1, axis=1)[:, :n]
                i = np.repeat(np.arange(hi - lo), n)
                self._exact(lo, i, top.ravel(), vec, x, norm, bound)
                bound[i, top.ravel()] = -np.inf
            i, j = np.nonzero(bound >= self.score[part, -1][:, None])
            for stat_q, stat_x in zip(self.stats[1:], own[1:]):
                fine = np.einsum("ij,ij->i", stat_q[lo + i], stat_x[j]) + slack[i, j]
                alive = fine >= self.score[lo + i, -1]
                i, j = i[alive], j[alive]
            self._exact(lo, i, j, vec, x, norm, bound)

    def _exact(self, lo: int, i: np.ndarray, j: np.ndarray, vec: np.ndarray, x: np.ndarray, norm: np.ndarray, bound: np.ndarray) -> None:
        alive = np.isfinite(bound[i, j])
        i, j = i[alive], j[alive]
        if not len(i):
            return
        s = _products(self.q[lo + i], x[j], self.norm[lo + i], norm[j])
        low, last = self.score[lo + i, -1], self.vec[lo + i, -1]
        alive = (s > low) | (s == low) & (vec[j] < last)
        i, j, s = i[alive], j[alive], s[alive]
        order = np.lexsort((vec[j], ~s, i))
        i, j, s = i[order], j[order], s[order]
        edge = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        rank = np.arange(len(i)) - np.repeat(edge, np.diff(np.r_[edge, len(i)]))
        i, j, s = i[rank < self.k], j[rank < self.k], s[rank < self.k]
        edge = np.r_[np.flatnonzero(np.r_[True, i[1:] != i[:-1]]), len(i)] if len(i) else np.array([0])
        for a, b in zip(edge[:-1], edge[1:]):
            q = lo + i[a]
            score, ids = np.r_[self.score[q], s[a:b]], np.r_[self.vec[q], vec[j[a:b]]]
            keep = np.lexsort((ids, ~score))[: self.k]
            self.score[q], self.vec[q] = score[keep], ids[keep]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ok = self.score > EMPTY
        return np.repeat(self.ids, self.k)[ok.ravel()], self.vec[ok], self.score[ok]


def whole(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id and v, an array of long, of the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.col(vector_col).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.col(id_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.when(F.abs(x * scale) < F.lit(2.0**63), F.floor(x * scale)).otherwise(F.raise_error(F.lit("a scaled component is no 64-bit integer")).cast("long"))).alias("v"))


def _matrix(b: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    col = b.column(1)
    sizes = np.diff(col.offsets.to_numpy())
    ids = b.column(0).to_numpy(zero_copy_only=False)
    values = col.flatten().to_numpy(zero_copy_only=False)
    same = sizes == width
    return ids[same], values[np.repeat(same, sizes)].reshape(-1, width)


def search(vectors: DataFrame, queries: str = "vec_id % 100 = 0", k: int = TOP, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best. ``queries``: SQL over vec_id. A block of queries goes to the tasks at once."""
    spark = vectors.sparkSession
    rows = whole(vectors, id_col, vector_col, scale)
    asked = cut(rows.where(queries).withColumn("width", F.size("v")))
    sizes = [(r.width, r["count"]) for r in asked.groupBy("width").count().orderBy("width").collect()]
    found = None
    for width, n in sizes:
        parts = -(-n // block)
        own = cut(asked.where(F.col("width") == width).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts))))
        for p in range(parts):
            got = own.where(F.col("part") == p).select("vec_id", "v").collect()
            if not got:
                continue
            shared = spark.sparkContext.broadcast((np.array([r.vec_id for r in got], np.int64), np.array([r.v for r in got], np.int64)))

            def step(batches: Iterator[pa.RecordBatch], shared=shared, width=width) -> Iterator[pa.RecordBatch]:
                b = Block(*shared.value, k)
                for batch in batches:
                    ids, x = _matrix(batch, width)
                    for lo in range(0, len(ids), ROWS):
                        b.meet(ids[lo : lo + ROWS], x[lo : lo + ROWS])
                q, v, s = b.found()
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s)], names=["query_id", "vec_id", "score"])

            here = cut(map_text(rows, step, "query_id long, vec_id long, score long"))
            found = here if found is None else found.unionByName(here)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
