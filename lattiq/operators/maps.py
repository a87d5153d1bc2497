"""Pixel maps: pooled gradients, smoothing, principal components as colours, object tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import gaussian
from .grid import gradient, mirrored, per_grid


def image_sobel(pixels: DataFrame, patch: int, pool: str = "mean") -> DataFrame:
    """(image_id, row, col, score): gradient size of each pixel (mirrored edges), pooled per patch by mean, l2 or max. Missing pixels
    count as 0."""
    cells = pixels.select("image_id", F.col("y").alias("row"), F.col("x").alias("col"), F.array(F.col("value").cast("double")).alias("features"))

    def size(image: np.ndarray, there: np.ndarray) -> np.ndarray:
        return np.hypot(*gradient(mirrored(image[:, :, 0])))

    g = per_grid(cells, "image_id", size, "score double")
    how = {"mean": F.avg("score"), "l2": F.sqrt(F.sum(F.col("score") * F.col("score"))), "max": F.max("score")}[pool]
    return g.groupBy("image_id", F.expr(f"row div {patch}").alias("row"), F.expr(f"col div {patch}").alias("col")).agg(how.alias("score"))


def gradient_image(pixels: DataFrame) -> DataFrame:
    """(image_id, y, x, value): the size of the grey gradient (mirrored edges) of (image_id, y, x, r, g, b), scaled to 0 to 255 by the
    image's largest and cut to whole numbers; an image without a gradient is 0. An image is one group."""
    grey = F.array((0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")).cast("double"))

    def size(cells: np.ndarray, there: np.ndarray) -> np.ndarray:
        gx, gy = gradient(mirrored(cells[:, :, 0]))
        g = np.sqrt(gx * gx + gy * gy)
        return np.floor(np.clip(g / g.max() * 255.0, 0, 255)) if g.max() > 1e-8 else np.zeros_like(g)

    rows = pixels.select("image_id", F.col("y").alias("row"), F.col("x").alias("col"), grey.alias("features"))
    return per_grid(rows, "image_id", size, "value double").withColumnsRenamed({"row": "y", "col": "x"})


def smooth(pixels: DataFrame, height: int | None, width: int, sigma: float) -> DataFrame:
    """(image_id, y, x, score) after a Gaussian with mirrored edges; missing pixels count as 0. An image is one group; with no
    ``height`` it ends at its own last row."""
    weights = np.array(gaussian(sigma))
    r = len(weights) // 2

    def blur(m: np.ndarray) -> np.ndarray:
        p = np.pad(m, ((r, r), (0, 0)), mode="symmetric")
        return sum(w * p[i : i + m.shape[0]] for i, w in enumerate(weights))

    def one(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        y = t.column("y").to_numpy()
        m = np.zeros((int(y.max()) + 1 if height is None else height, width))
        m[y, t.column("x").to_numpy()] = t.column("score").to_numpy()
        m = blur(blur(m).T).T
        y, x = np.indices(m.shape).reshape(2, -1)
        return pa.table({"image_id": pa.array([t.column("image_id")[0].as_py()] * m.size, t.schema.field("image_id").type), "y": y, "x": x, "score": m.reshape(-1)})

    kind = dict(pixels.dtypes)["image_id"]
    return pixels.select("image_id", "y", "x", "score").groupBy("image_id").applyInArrow(one, f"image_id {kind}, y long, x long, score double")


def pca_colours(df: DataFrame) -> DataFrame:
    """(image_id, row, col, r, g, b): the first three principal components of an image's vectors, each scaled to 0 to 1."""

    def one(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        x = t.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        z = np.zeros((t.num_rows, 3))
        axes = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:3]
        z[:, : len(axes)] = (x - x.mean(0)) @ axes.T
        z = (z - z.min(0)) / np.maximum(z.max(0) - z.min(0), 1e-12)
        return pa.table({"image_id": t.column("image_id"), "row": t.column("row"), "col": t.column("col"), "r": z[:, 0], "g": z[:, 1], "b": z[:, 2]})

    kinds = ", ".join(f"{n} {t}" for n, t in df.select("image_id", "row", "col").dtypes)
    return df.select("image_id", "row", "col", "features").groupBy("image_id").applyInArrow(one, f"{kinds}, r double, g double, b double")


def per_object(metrics: DataFrame, names: Sequence[str], key: str = "object") -> DataFrame:
    """Metrics of each object and, under ``mean``, the mean over objects."""
    rows = metrics.select(F.col(key).cast("string").alias(key), *names)
    return rows.unionByName(rows.agg(*[F.avg(n).alias(n) for n in names]).select(F.lit("mean").alias(key), *names))


def per_image_sizes(df: DataFrame, image: str = "image_id") -> DataFrame:
    """One row: the least, largest and mean number of patches of an image."""
    sizes = df.groupBy(image).agg(F.count("*").alias("n"))
    return sizes.agg(F.min("n").alias("low"), F.max("n").alias("high"), F.avg("n").alias("mean"))


def colour_limits(df: DataFrame, key: str = "object", score: str = "score", label: str = "is_defect") -> DataFrame:
    """The upper colour limit of each object's maps: the largest score of its good patches."""
    return df.filter(~F.col(label)).groupBy(key).agg(F.max(score).alias("vmax"))


def max_of_smoothed(pixels: DataFrame, height: int | None, width: int, sigma: float) -> DataFrame:
    """(image_id, score): the largest value of each smoothed map."""
    return smooth(pixels, height, width, sigma).groupBy("image_id").agg(F.max("score").alias("score"))


def timing(df: DataFrame, seconds: str = "seconds", keys: Sequence[str] = ()) -> DataFrame:
    """Total and mean time, and samples per second."""
    s = F.col(seconds)
    return df.groupBy(*keys).agg(F.count(s).alias("n"), F.sum(s).alias("total"), F.avg(s).alias("mean"), F.try_divide(F.count(s), F.sum(s)).alias("per_second"))


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """Data behind a histogram plot: counts of equal bins, the last one closed; values outside are left out."""
    at = F.least(F.floor((value - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    return df.filter((value >= low) & (value <= high)).groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("n"))
