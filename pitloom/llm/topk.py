"""Exact top-k inner products: norm-sorted vectors, partial sums after an SVD rotation, Cauchy-Schwarz bounds.

Vectors are dealt into blocks by descending length. For a query a block needs no look once its
greatest length times the query's is below the query's k-th best score so far. Within a block the first
rotated coordinates, which hold most of the length, give a partial sum; the rest is bounded by the product of the
residual lengths. What may still reach the k-th best is scored exactly, in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize
from .words import shipped

_BLOCK = 2048


def integer_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """id, x array<double>, norm: floor(scale * component), exact. Null ids, null vectors and those with null or non-finite components are left out."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = lambda c: F.when(F.abs(c) < 2.0**53, F.floor(c).cast("double")).otherwise(c)
    rows = rows.where(F.coalesce(fine, F.lit(False))).select("id", F.transform("v", lambda c: whole(c * scale)).alias("x"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, c: s + c * c)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of float64, shorter vectors filled up with zeros (what they lack adds nothing to an inner product)."""
    size = np.asarray(column.value_lengths())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(size) and (size == dim).all():
        return flat.reshape(-1, dim).astype(np.float64)
    out = np.zeros((len(size), dim))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _gram(rows: DataFrame, dim: int) -> np.ndarray:
    """The sum of x xᵀ: one dim x dim matrix from each task, added up by Spark."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = _matrix(batch.column("x"), dim)
            total += x.T @ x
        yield pa.RecordBatch.from_pydict({"place": np.arange(dim * dim), "value": total.ravel()})

    sums = rows.select("x").mapInArrow(of, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toPandas()
    out = np.zeros(dim * dim)
    out[sums["place"].to_numpy(np.int64)] = sums["value"].to_numpy(float)
    return out.reshape(dim, dim)


class Best:
    """The k best of each query so far: by score, then smaller id. Scores are Python integers if `wide`, else floats that hold integers."""

    def __init__(self, queries: int, k: int, wide: bool = False) -> None:
        self.k = k
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)
        self.scores = np.full((queries, k), -np.inf, object if wide else float)

    def least(self) -> np.ndarray:
        """A new score must reach this."""
        return self.scores[:, -1].astype(float)

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids[q], ids]), np.concatenate([self.scores[q], scores])
        order = np.array(sorted(range(len(ids)), key=lambda n: (-scores[n], ids[n]))[: self.k]) if scores.dtype == object else np.lexsort((ids, -scores))[: self.k]
        self.ids[q], self.scores[q] = ids[order], scores[order]


class Searcher:
    """Some queries, exactly and in rotated coordinates; head: how many of those a first look takes."""

    def __init__(self, ids: np.ndarray, times: np.ndarray, q: np.ndarray, rotation: np.ndarray, head: int, k: int, start: np.ndarray, wide: bool) -> None:
        self.ids, self.times, self.q, self.head, self.k, self.start, self.wide = ids, times, q, head, k, start, wide
        self.turn, turned = rotation, q @ rotation
        self.first, self.norm = turned[:, :head], np.linalg.norm(q, axis=1)
        self.rest = np.linalg.norm(turned[:, head:], axis=1)

    def look(self, ids: np.ndarray, x: np.ndarray, norms: np.ndarray, best: Best) -> None:
        """One block of vectors. Bounds get slack for rounding; what they let through is scored exactly."""
        most = np.nan_to_num(self.norm * norms.max(initial=0), nan=np.inf)
        slack = 1e-6 * (1 + most)
        floor = np.maximum(best.least(), self.start)
        floor -= 1e-9 * np.abs(np.where(np.isfinite(floor), floor, 0)) * self.wide  # rounded, if wide
        some = np.flatnonzero(most + slack >= floor)
        if not len(some):
            return
        turned = x @ self.turn
        rest = np.linalg.norm(turned[:, self.head :], axis=1)
        bound = np.nan_to_num(self.first[some] @ turned[:, : self.head].T + np.outer(self.rest[some], rest) + slack[some, None], nan=np.inf, posinf=np.inf, neginf=np.inf)
        for q, row in zip(some.tolist(), bound, strict=True):
            at = np.flatnonzero((row >= floor[q]) & (ids != self.ids[q]))
            if len(at):
                if self.wide:
                    mine = [int(c) for c in self.q[q]]
                    scores = np.array([sum(int(c) * d for c, d in zip(v, mine, strict=True)) for v in x[at]] + [None], object)[:-1]
                else:
                    scores = x[at] @ self.q[q]  # integers below 2^53, so exact
                keep = np.array([s >= floor[q] for s in scores]) if self.wide else scores >= floor[q]
                best.add(q, ids[at[keep]], scores[keep])


def search(vectors: DataFrame, *, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0, query_block: int = 8192) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose id is divisible by `every`, the k best other rows (all, if fewer).

    Score: the integer inner product of floor(scale * component); ties go to the smaller id. Null vectors and those with null or
    non-finite components take no part. A shorter vector counts as if filled up with zeros. If lengths allow scores of 2^53 or more, all are
    summed in Python's integers; what is beyond a long is reported as the nearest long. Rows with the query's id are no
    candidates. Every other row is: a repeated row is listed as often as it is there, and a query that is there several times (even with different
    vectors) lists its candidates for each. An empty table gives an empty one.

    Queries are taken in blocks of query_block, each broadcast (its size is bounded by the block's) over one scan of all vectors.
    """
    rows = integer_vectors(vectors, id_col=id_col, vector_col=vector_col, scale=scale).groupBy("id", "x").agg(F.max("norm").alias("norm"), F.count("*").alias("times"))
    spark = vectors.sparkSession
    sorted_ = materialize(rows.repartitionByRange(F.desc("norm"), "id").sortWithinPartitions(F.desc("norm"), "id"))
    shape = sorted_.agg(F.max(F.size("x")).alias("dim"), F.coalesce(F.max("norm"), F.lit(0.0)).alias("norm")).first()
    schema = "query_id long, vec_id long, score long, times long"
    asked = sorted_.where(F.col("id") % every == 0)
    out = spark.createDataFrame([], schema)
    if shape.dim is None:
        return out.select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    dim, wide = max(1, shape.dim), shape.norm**2 >= 2**53 if shape.norm < 1e150 else True
    values, axes = (np.ones(dim), np.eye(dim)) if wide else np.linalg.eigh(_gram(sorted_, dim))
    order = np.argsort(-values, kind="stable")
    share = np.cumsum(np.maximum(values[order], 0)) / max(values.sum(), 1e-300)
    head = min(dim, max(1, int(np.searchsorted(share, 0.8)) + 1))
    top = sorted_.orderBy(F.desc("norm"), "id").limit(_BLOCK).toPandas()
    top_x = _matrix(pa.array(list(top["x"]), pa.list_(pa.float64())), dim)
    blocks = max(1, -(-asked.count() // query_block))
    parts = []
    for b in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toPandas().sort_values("id", kind="stable")
        ids, q = mine["id"].to_numpy(np.int64), _matrix(pa.array(list(mine["x"]), pa.list_(pa.float64())), dim)
        searcher = Searcher(ids, mine["times"].to_numpy(np.int64), q, axes[:, order], head, k, np.full(len(ids), -np.inf), wide)
        first = Best(len(ids), k, wide)  # the longest vectors give every query a score to beat
        searcher.look(top["id"].to_numpy(np.int64), top_x, top["norm"].to_numpy(float), first)
        searcher.start = first.least()
        found = sorted_.mapInArrow(_scan(shipped(spark, searcher), dim), schema)
        parts.append(materialize(found) if blocks > 1 else found)
    for p in parts:
        out = out.unionByName(p)
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    each = out.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.least("times", F.lit(k)))))
    return each.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _scan(held, dim: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = held()
        best = Best(len(searcher.ids), searcher.k, searcher.wide)
        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK):
                part = batch.slice(at, _BLOCK)
                ids, x, norms = part.column("id").to_numpy(zero_copy_only=False), _matrix(part.column("x"), dim), part.column("norm").to_numpy(zero_copy_only=False)
                many = part.column("times").to_numpy(zero_copy_only=False)
                if (many > 1).any():  # listed as often as they are there, k times at most
                    again = np.repeat(np.arange(len(ids)), np.minimum(many, searcher.k))
                    ids, x, norms = ids[again], x[again], norms[again]
                searcher.look(ids, x, norms, best)
        q, place = np.nonzero(best.ids < np.iinfo(np.int64).max)
        scores = [max(-(2**63), min(2**63 - 1, int(s))) for s in best.scores[q, place]]
        yield pa.RecordBatch.from_pydict({"query_id": searcher.ids[q], "vec_id": best.ids[q, place], "score": pa.array(scores, pa.int64()), "times": searcher.times[q]})

    return of
