"""Patch scores as smooth pixel maps, tile by tile.

Resizing a grid with bilinear weights and smoothing it with a Gaussian are both linear, and separate for rows and columns. So
a tile of the map is W_y S W_x', S being the patches that reach it and W two narrow matrices that follow from the tile's
place. Each patch is sent to the tiles that it reaches (its own and those within the kernel's width), and a task holds one
tile, however large the map is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import gaussian

#: Rows and columns of a tile.
TILE = 512


def weights(cells: int, size: int, sigma: float, low: int, high: int) -> tuple[int, np.ndarray]:
    """The first patch that reaches the places [low, high) of a line of ``size`` pixels over ``cells`` patches, and how much each
    patch from it on counts at each place. Centres are matched, places beyond the outer centres repeat the outer patch, and
    the kernel (none for a ``sigma`` of 0) mirrors the line at its ends."""
    kernel = np.array(gaussian(sigma)) if sigma > 0 else np.ones(1)
    r = len(kernel) // 2
    place = np.mod(np.arange(low - r, high + r), 2 * size)
    place = np.where(place >= size, 2 * size - 1 - place, place)
    at = np.clip((place + 0.5) * cells / size - 0.5, 0, cells - 1)
    left = np.floor(at).astype(np.int64)
    right, share = np.minimum(left + 1, cells - 1), at - np.floor(at)
    first = int(left.min())
    bilinear = np.zeros((len(at), int(right.max()) - first + 1))
    rows = np.arange(len(at))
    np.add.at(bilinear, (rows, left - first), 1 - share)
    np.add.at(bilinear, (rows, right - first), share)
    return first, sum(w * bilinear[i : i + high - low] for i, w in enumerate(kernel))


def _reached(at: Column, cells: int, size: int, r: int, tile: int) -> Column:
    """The tiles that a patch reaches along a line, and at most one more at either end."""
    step = size / cells
    low = F.when(at == 0, F.lit(0)).otherwise(F.floor((at - 0.5) * step) - r - 1)
    high = F.when(at == cells - 1, F.lit(size - 1)).otherwise(F.ceil((at + 1.5) * step) + r + 1)
    return F.sequence(F.floor(F.greatest(low, F.lit(0)) / tile), F.floor(F.least(high, F.lit(size - 1)) / tile))


def distance_map(patches: DataFrame, rows: int, cols: int, height: int, width: int, sigma: float = 4.0, tile: int = TILE, score: str = "score", largest: bool = False, whole: bool = True) -> DataFrame:
    """(image_id, y, x, score): the scores of grids of ``rows`` x ``cols`` patches (image_id, row, col, score) as maps of ``height`` x
    ``width`` pixels, bilinear and then smoothed; with ``largest`` (image_id, score) of each tile's largest value. Missing
    patches count as 0; images without any patch have no map. Unless maps are ``whole``, pixels that no patch reaches are left
    out."""
    r = int(4 * sigma + 0.5) if sigma > 0 else 0
    sent = patches.select("image_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col(score).cast("double").alias("score"))
    images = sent.select("image_id").distinct().withColumn("ty", F.explode(F.sequence(F.lit(0), F.lit((height - 1) // tile)))).withColumn("tx", F.explode(F.sequence(F.lit(0), F.lit((width - 1) // tile))))
    none = images.select("image_id", F.col("ty").cast("long"), F.col("tx").cast("long"), *[F.lit(None).cast(t).alias(c) for c, t in (("row", "long"), ("col", "long"), ("score", "double"))])
    sent = sent.withColumn("ty", F.explode(_reached(F.col("row"), rows, height, r, tile))).withColumn("tx", F.explode(_reached(F.col("col"), cols, width, r, tile)))
    sent = sent.select("image_id", "ty", "tx", "row", "col", "score")
    sent = sent.unionByName(none) if whole else sent  # tiles that no patch reaches are 0

    def one(t: pa.Table) -> pa.Table:
        ty, tx = t.column("ty")[0].as_py() * tile, t.column("tx")[0].as_py() * tile
        top, down = weights(rows, height, sigma, ty, min(ty + tile, height))
        first, across = weights(cols, width, sigma, tx, min(tx + tile, width))
        known = t.filter(t.column("row").is_valid())
        y, x, v = (known.column(c).to_numpy() for c in ("row", "col", "score"))
        y, x = y - top, x - first
        near = (y >= 0) & (y < down.shape[1]) & (x >= 0) & (x < across.shape[1])
        s = np.zeros((down.shape[1], across.shape[1]))
        s[y[near], x[near]] = v[near]
        m = down @ s @ across.T
        if largest:
            return pa.table({"image_id": t.column("image_id").slice(0, 1), "score": pa.array([m.max()])})
        there = np.ones(s.shape, bool)
        if not whole:
            there[:] = False
            there[y[near], x[near]] = True
        at = np.nonzero((down > 0).astype(float) @ there @ (across > 0).T.astype(float))
        return pa.table({"image_id": pa.repeat(t.column("image_id")[0], len(at[0])), "y": at[0] + ty, "x": at[1] + tx, "score": m[at]})

    kind = dict(patches.dtypes)["image_id"]
    return sent.groupBy("image_id", "ty", "tx").applyInArrow(one, f"image_id {kind}, score double" if largest else f"image_id {kind}, y long, x long, score double")


def max_of_map(patches: DataFrame, rows: int, cols: int, height: int, width: int, sigma: float = 4.0, tile: int = TILE, score: str = "score") -> DataFrame:
    """(image_id, score): the largest value of each image's ``distance_map``; pixels never leave their task."""
    return distance_map(patches, rows, cols, height, width, sigma, tile, score, largest=True).groupBy("image_id").agg(F.max("score").alias("score"))
