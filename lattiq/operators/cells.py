"""Exact neighbours with pruning: the bank is cut into cells around pivots, and a query meets only cells that can hold a
neighbour by the triangle inequality.

A cell is what is nearer to its pivot than to any other, and knows between which distances from the pivot its rows are. So a
query at distance d of the pivot is at least max(d - outer, inner - d) away from all of them. A query meets its nearest cells
first; their k-th distance says which others it still has to meet. Lengths are taken out for ``cosine``, for which
1 - cos is half the squared Euclidean distance; vectors without a length are met by all and meet all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .knn import BLOCK_BYTES, FOUND, _matrix, _nearest
from .shared import small_batches, spent, written

#: Most pivots, cells that a query meets first, and how much nearer than computed a cell may be (floating point).
PIVOTS, FIRST, SLACK = 1024, 2, 1e-6
#: The cell of vectors without a length.
LOOSE = -1
PLACED = "id long, grp long, features array<double>, cell int, away double"
ASKED = "id long, cell int"


class Pivots:
    """The pivots, and what the cells around them hold (inner and outer distance)."""

    def __init__(self, points: np.ndarray, metric: str):
        self.metric = metric
        self.points = self.turned(points)[0]
        self.cells = np.zeros(0, np.int32)

    def turned(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors as points of a Euclidean space, and which of them have a place there."""
        if self.metric != "cosine":
            return x, np.ones(len(x), bool)
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.maximum(size, 1e-12), size[:, 0] > 1e-12

    def with_cells(self, cells: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> Pivots:
        self.cells, self.inner, self.outer = cells, inner, outer
        return self

    def away(self, x: np.ndarray) -> np.ndarray:
        """Euclidean distances to the pivots."""
        square = (x * x).sum(1)[:, None] + (self.points * self.points).sum(1)[None, :] - 2.0 * (x @ self.points.T)
        return np.sqrt(np.maximum(square, 0.0))

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """The least distance that a row of each cell (a column) can have."""
        there, real = self.turned(x)
        d, loose = self.away(there), self.cells == LOOSE
        at = np.where(loose, 0, self.cells)
        low = np.maximum(d[:, at] - self.outer, self.inner - d[:, at])
        low -= SLACK * np.maximum(1.0, d[:, at])
        low[:, loose] = -np.inf
        low[~real] = -np.inf
        return low

    def euclidean(self, dist: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2.0 * dist, 0.0)) if self.metric == "cosine" else dist


def _placed(bank: DataFrame, shared) -> DataFrame:
    """The bank with each row's cell and its distance from the pivot."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, real = shared.value.turned(_matrix(b.column(2)))
                d = shared.value.away(x)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.where(real, cell, LOOSE), pa.int32()), pa.array(d[np.arange(len(d)), cell])], ["id", "grp", "features", "cell", "away"])

    return bank.mapInArrow(place, PLACED)


def _met(queries: DataFrame, asked: DataFrame, bank: DataFrame, sizes: DataFrame, width: int, k: int, metric: str) -> DataFrame:
    """The k nearest rows of the cells that queries ask. Cells and their queries meet in blocks of bounded bytes, so a cell that
    holds most of the bank is as many blocks as it needs."""
    rows = max(1, BLOCK_BYTES // (8 * max(1, width)))

    def blocks(df: DataFrame, counts: DataFrame, name: str) -> DataFrame:
        parts = counts.select("cell", F.ceil(F.col("n") / rows).cast("int").alias("parts"))
        dealt = df.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
        return dealt.groupBy("cell", "part").agg(F.collect_list(F.struct("id", "grp", "features")).alias(name)).withColumnRenamed("part", f"{name}_part")

    wanted = asked.join(queries, "id")  # at most PIVOTS + 1 cells, so their counts are small tables
    left = blocks(wanted, asked.groupBy("cell").agg(F.count("*").alias("n")), "q")
    both = left.join(blocks(bank, sizes, "b"), "cell").select("q", "b")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for i in range(x.num_rows):
                u, v = x.column(0)[i].values, x.column(1)[i].values
                yield _nearest(u.field(0).to_numpy(), u.field(1).to_numpy(), _matrix(u.field(2)), v.field(0).to_numpy(), v.field(1).to_numpy(), _matrix(v.field(2)), k, metric)

    return both.mapInArrow(score, FOUND)


def pruned(q: DataFrame, b: DataFrame, k: int, metric: str, pivots: int | None = None, first: int = FIRST) -> tuple[DataFrame, DataFrame]:
    """(query_id, bank_id, dist) candidates that hold each query's k nearest, and (query_id, compared): how many bank rows each query
    was held against. Both tables have id, grp and features without nulls. The steps are written to the shared folder."""
    spark = q.sparkSession
    small_batches(spark)
    n, width = b.agg(F.count("*"), F.max(F.size("features"))).first()
    if not n:
        none = spark.createDataFrame([], FOUND)
        return none, none.select("query_id", F.lit(0).cast("long").alias("compared"))
    count = min(PIVOTS, max(1, int(n**0.5))) if pivots is None else pivots
    drawn = b.orderBy(F.xxhash64(F.lit(11), "id"), "id").limit(count).select("features").toArrow().combine_chunks()
    around = Pivots(_matrix(drawn.column("features").combine_chunks()), metric)
    bank = written(_placed(b, spark.sparkContext.broadcast(around)), "cells")
    sizes = bank.groupBy("cell").agg(F.count("*").alias("n"), F.min("away").alias("inner"), F.max("away").alias("outer"))
    cells = sorted(sizes.collect())  # a row for each pivot at most
    sizes = spark.createDataFrame([(r.cell, r.n) for r in cells], "cell int, n long")
    shared = spark.sparkContext.broadcast(around.with_cells(*[np.array(c) for c in zip(*[(r.cell, r.inner, r.outer) for r in cells])]))

    def nearest_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for x in batches:
            if x.num_rows:
                d, loose = p.away(p.turned(_matrix(x.column(2)))[0]), p.cells == LOOSE
                d = np.where(loose, -1.0, d[:, np.where(loose, 0, p.cells)])
                order = np.argsort(d, axis=1, kind="stable")[:, : first + int(loose.any())]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(x.column(0).to_numpy(), order.shape[1])), pa.array(p.cells[order].reshape(-1), pa.int32())], ["id", "cell"])

    asked = written(q.mapInArrow(nearest_cells, ASKED), "asked")
    found = written(_met(q, asked, bank, sizes, width, k, metric), "near")
    own = Window.partitionBy("query_id").orderBy("dist", "bank_id")
    limit = found.withColumn("r", F.row_number().over(own)).filter(F.col("r") == k).select(F.col("query_id").alias("id"), "dist")
    rows = q.join(limit, "id", "left").select("id", "grp", "features", "dist")

    def other_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for x in batches:
            if x.num_rows:
                most = p.euclidean(np.nan_to_num(x.column(3).to_numpy(zero_copy_only=False), nan=np.inf))
                row, cell = np.nonzero(p.bounds(_matrix(x.column(2))) <= most[:, None] * (1 + SLACK))
                yield pa.RecordBatch.from_arrays([pa.array(x.column(0).to_numpy()[row]), pa.array(p.cells[cell], pa.int32())], ["id", "cell"])

    more = written(rows.mapInArrow(other_cells, ASKED).join(asked, ["id", "cell"], "left_anti"), "asked")
    all_found = written(found.unionByName(_met(q, more, bank, sizes, width, k, metric)), "found")
    compared = written(asked.unionByName(more).join(F.broadcast(sizes), "cell").groupBy(F.col("id").alias("query_id")).agg(F.sum("n").alias("compared")), "compared")
    spent(bank, asked, found, more)
    return all_found, compared
