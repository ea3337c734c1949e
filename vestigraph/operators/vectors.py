"""Exact nearest vectors by cosine: blocks around pivots, met on a grid, skipped where a bound says that they cannot matter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block; blocks of queries that a grid cell holds, and blocks of vectors that stream by them.
BLOCK, HELD, STREAMED = 2048, 4, 32
#: Vectors, chosen by a hash of their id, around which the others are put together.
PIVOTS = 64
_PACKED = "ids binary, rows binary, dim int, center binary, angle double"


def _units(vectors: list[list[float]], dim: int) -> np.ndarray:
    """Rows of length 1, or 0. A shorter vector is padded with zeros, so a product counts the common length."""
    rows = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        rows[i, : len(v)] = [0.0 if x is None else x for x in v]
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def _widened(rows: np.ndarray, dim: int) -> np.ndarray:
    return rows if rows.shape[1] >= dim else np.pad(rows, ((0, 0), (0, dim - rows.shape[1])))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    dim = max(a.shape[1], b.shape[1])
    return _widened(a, dim) @ _widened(b, dim).T


def _block(ids: list[int], vectors: list[list[float]]) -> tuple:
    """ids and unit rows of a block, its center, and the widest angle between a row and that; any angle if a row is zero."""
    rows = _units(vectors, max(1, *map(len, vectors)))
    center = _units([rows.mean(0).tolist()], rows.shape[1])
    angle = float(np.arccos(np.clip(rows @ center[0], -1, 1)).max()) if rows.any(1).all() and center.any() else np.pi
    return np.asarray(ids, "<i8").tobytes(), rows.tobytes(), rows.shape[1], center.tobytes(), angle


def _packed(vectors: DataFrame, pivots: np.ndarray, size: int) -> DataFrame:
    """Blocks of vectors that are near the same pivot. A pivot with any share of the vectors is many ranges of ids' hashes."""
    held = vectors.sparkSession.sparkContext.broadcast(pivots)  # PIVOTS vectors

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column("v").to_pylist()
            near = _product(_units(rows, max([1, *map(len, rows)])), held.value).argmax(1) if len(held.value) else np.zeros(len(rows), np.int64)
            yield b.append_column("pivot", pa.array(near.astype(np.int32), pa.int32()))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, rows, out = None, [], [], []
        for b in batches:
            for one, v, pivot in zip(b.column("id").to_pylist(), b.column("v").to_pylist(), b.column("pivot").to_pylist(), strict=True):
                if ids and (pivot != at or len(ids) >= size):
                    out.append(_block(ids, rows))
                    ids, rows = [], []
                at = pivot
                ids.append(one)
                rows.append(v)
            if out:
                yield _batch(out)
                out = []
        if ids:
            yield _batch([_block(ids, rows)])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.float64()), strict=True)], names=["ids", "rows", "dim", "center", "angle"])

    dealt = vectors.mapInArrow(nearest, "id long, v array<double>, pivot int").repartitionByRange("pivot", F.xxhash64("id"))
    return dealt.sortWithinPartitions("pivot", F.xxhash64("id")).mapInArrow(blocks, _PACKED)


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int, block: int = BLOCK, vec: str = "vec_id") -> DataFrame:
    """(query_id, vec, score, rank): for each query the k nearest others by cosine, then by id; exact, over all vectors.

    Vectors of different lengths are compared over the common one, each with its whole length; a zero vector has cosine 0;
    null vectors are left out. Blocks of queries are dealt to the rows of a grid and blocks of vectors to its columns, and
    each cell of the grid is a task's: it holds its queries, lets its vectors stream by, and keeps each query's k best. The
    angle between query and center, less the block's widest angle, bounds the cosine of all in the block, so a block that
    cannot come among any query's k best is skipped.
    """
    columns = lambda df: df.select(F.col(vec).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).where("v is not null")
    every, asked = columns(vectors), columns(queries)
    sample = [r[0] for r in every.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).select("v").collect()]
    pivots = _units(sample, max([1, *map(len, sample)]))
    grid_rows, grid_columns = (max(1, -(-df.count() // (block * n))) for df, n in ((asked, HELD), (every, STREAMED)))
    deal = lambda df, own, n, other, m, side: df.select(F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other), F.lit(side).alias("side"), "*").select("r", "c", "side", "ids", "rows", "dim", "center", "angle")
    cells = deal(_packed(asked, pivots, block), "r", grid_rows, "c", grid_columns, 0).unionByName(deal(_packed(every, pivots, block), "c", grid_columns, "r", grid_rows, 1))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in batches:
            for r, c, side, ids, rows, dim, center, angle in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if (r, c) != at:
                    yield from _emitted(held, vec)
                    at, held = (r, c), []
                matrix = np.frombuffer(rows).reshape(-1, dim)
                if side == 0:
                    held.append(_Held(np.frombuffer(ids, "<i8"), matrix, k))
                    continue
                for queries_ in held:
                    queries_.meet(np.frombuffer(ids, "<i8"), matrix, np.frombuffer(center)[None, :], angle)
        yield from _emitted(held, vec)

    met = cells.repartition("r", "c").sortWithinPartitions("r", "c", "side").mapInArrow(scan, f"query_id long, {vec} long, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(vec))
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class _Held:
    """A block of queries and the k nearest vectors of each so far."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int):
        self.ids, self.rows, self.k = ids, rows, k
        self.score, self.near = np.full((len(ids), 0), -np.inf), np.zeros((len(ids), 0), np.int64)

    def meet(self, ids: np.ndarray, rows: np.ndarray, center: np.ndarray, angle: float) -> None:
        least = self.score[:, -1] if self.score.shape[1] == self.k else np.full(len(self.ids), -np.inf)
        apart = np.arccos(np.clip(_product(self.rows, center)[:, 0], -1, 1))
        bound = np.where(self.rows.any(1), np.cos(np.clip(apart - angle, 0, np.pi)), 0.0)
        alive = np.flatnonzero(bound >= least - 1e-9)
        if not len(alive):
            return
        score = _product(self.rows[alive], rows)
        score[self.ids[alive][:, None] == ids[None, :]] = -np.inf
        score, near = np.concatenate([self.score[alive], score], 1), np.concatenate([self.near[alive], np.broadcast_to(ids, score.shape)], 1)
        if score.shape[1] > 4 * self.k:  # what is below the k-th best goes before the sort; ties stay
            cut = np.partition(score, -self.k, axis=1)[:, -self.k]
            width = int((score >= cut[:, None]).sum(1).max())
            part = np.argpartition(-score, min(width, score.shape[1] - 1), axis=1)[:, :width]
            score, near = np.take_along_axis(score, part, 1), np.take_along_axis(near, part, 1)
        order = np.lexsort((near, -score), axis=1)[:, : self.k]
        width = max(order.shape[1], self.score.shape[1])
        grown_score, grown_near = np.full((len(self.ids), width), -np.inf), np.zeros((len(self.ids), width), np.int64)
        grown_score[:, : self.score.shape[1]], grown_near[:, : self.near.shape[1]] = self.score, self.near
        grown_score[alive], grown_near[alive] = -np.inf, 0
        grown_score[alive[:, None], np.arange(order.shape[1])], grown_near[alive[:, None], np.arange(order.shape[1])] = np.take_along_axis(score, order, 1), np.take_along_axis(near, order, 1)
        self.score, self.near = grown_score, grown_near


def _emitted(held: list[_Held], vec: str) -> Iterator[pa.RecordBatch]:
    for x in held:
        kept = np.isfinite(x.score)
        q, _ = np.nonzero(kept)
        yield pa.RecordBatch.from_arrays([pa.array(x.ids[q]), pa.array(x.near[kept]), pa.array(x.score[kept])], names=["query_id", vec, "score"])
