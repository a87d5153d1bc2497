"""Operators over grids of vectors and over attention matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import percentiles
from .shared import written

#: The Sobel weights (row offset, column offset) -> (x, y).
SOBEL = {(-1, -1): (-1, -1), (-1, 0): (0, -2), (-1, 1): (1, -1), (0, -1): (-2, 0), (0, 1): (2, 0), (1, -1): (-1, 1), (1, 0): (0, 2), (1, 1): (1, 1)}


def with_grid(df: DataFrame, width: int, index: str = "idx") -> DataFrame:
    """Adds row and col of a token's index."""
    return df.withColumn("row", F.expr(f"`{index}` div {width}")).withColumn("col", F.col(index) % width)


def per_grid(df: DataFrame, image: str, compute, out: str, shape: tuple[int, int] | None = None) -> DataFrame:
    """(image, row, col, ``out``): each image's vectors as one array of cells (missing ones are 0, with a mask of those that are
    there) through ``compute``, which gives one value or vector a cell. Each vector is moved once; an image is one group."""

    def one(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        r, c = t.column("row").to_numpy(), t.column("col").to_numpy()
        x = t.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(r), -1)
        high, wide = shape or (int(r.max()) + 1, int(c.max()) + 1)
        cells, there = np.zeros((high, wide, x.shape[1])), np.zeros((high, wide), bool)
        cells[r, c], there[r, c] = x, True
        found = compute(cells, there)[r, c]
        values = pa.array(found) if found.ndim == 1 else pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, found.shape[1]), pa.int32()), pa.array(found.reshape(-1)))
        return pa.table({image: t.column(image), "row": t.column("row"), "col": t.column("col"), out.split()[0]: values})

    rows = df.select(image, "row", "col", F.transform("features", lambda v: v.cast("double")).alias("features"))
    kinds = ", ".join(f"`{n}` {k}" for n, k in df.select(image, "row", "col").dtypes)
    return rows.groupBy(image).applyInArrow(one, f"{kinds}, {out}")


def neighbour_mean(df: DataFrame, rows: int, cols: int, kernel: int = 3, image: str = "image_id") -> DataFrame:
    """(image, row, col, features): the mean of the vectors of a window of odd size, edges repeated, over the
    cells that an image has. A size of 1 or less changes nothing."""
    if kernel <= 1:
        return df.select(image, "row", "col", "features")
    if kernel % 2 == 0:
        raise ValueError("the kernel must be odd")
    r = kernel // 2

    def mean(cells: np.ndarray, there: np.ndarray) -> np.ndarray:
        value, weight = np.pad(cells, ((r, r), (r, r), (0, 0)), mode="edge"), np.pad(there.astype(float), r, mode="edge")
        moved = [(slice(a, a + rows), slice(b, b + cols)) for a in range(kernel) for b in range(kernel)]
        return sum(value[m] for m in moved) / np.maximum(sum(weight[m] for m in moved), 1e-12)[:, :, None]

    return per_grid(df, image, mean, "features array<double>", (rows, cols))


def gradient(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sobel derivatives (x, y) of an array whose border of one cell is already there."""
    high, wide = p.shape[0] - 2, p.shape[1] - 2
    return tuple(sum(w[i] * p[1 + a : 1 + a + high, 1 + b : 1 + b + wide] for (a, b), w in SOBEL.items() if w[i]) for i in (0, 1))


def mirrored(x: np.ndarray) -> np.ndarray:
    """``x`` with a border of one cell that mirrors at the edge cells; an axis of one cell repeats it."""
    for axis in (0, 1):
        width = [(0, 0)] * x.ndim
        width[axis] = (1, 1)
        x = np.pad(x, width, mode="reflect" if x.shape[axis] > 1 else "edge")
    return x


def sobel_norm(df: DataFrame, reduce: str = "l2", image: str = "image_id") -> DataFrame:
    """(image, row, col, score): sqrt(gx^2 + gy^2 + 1e-8) of each channel with zero padding, then l2, mean or max over channels."""
    how = {"l2": lambda g: np.sqrt((g * g).sum(2)), "mean": lambda g: g.mean(2), "max": lambda g: g.max(2)}[reduce]

    def size(cells: np.ndarray, there: np.ndarray) -> np.ndarray:
        gx, gy = gradient(np.pad(cells, ((1, 1), (1, 1), (0, 0))))
        return how(np.sqrt(gx * gx + gy * gy + 1e-8))

    return per_grid(df, image, size, "score double")


def reduce_heads(attention: DataFrame, how: str = "mean") -> DataFrame:
    """(image_id, layer, q, k, w): mean or max over heads."""
    return attention.groupBy("image_id", "layer", "q", "k").agg({"mean": F.avg, "max": F.max}[how]("w").alias("w"))


#: Added to sums of rows before weights are divided by them.
ROW_EPS = 1e-8


def _rows_to_one(weights: DataFrame) -> DataFrame:
    row = Window.partitionBy("image_id", "layer", "q")  # as many weights as there are tokens
    return weights.withColumn("w", F.col("w") / (F.sum("w").over(row) + ROW_EPS))


def rollout_weights(attention: DataFrame, discard: float = 0.0, residual: bool = True) -> DataFrame:
    """(image_id, layer, q, k, w): each layer's matrix with the identity added and rows summing to 1; then, with ``discard``, weights
    below the matrix's own percentile 100 (1 - discard) are dropped and rows sum to 1 again. Pairs that the table lacks are
    weights of 0, and count as such in the percentile. With ``discard`` the weights are written to the shared folder first."""
    w = attention.select("image_id", "layer", F.col("q").cast("long").alias("q"), F.col("k").cast("long").alias("k"), F.col("w").cast("double").alias("w"))
    keys = ["image_id", "layer"]
    tokens = w.groupBy(*keys).agg((F.max(F.greatest("q", "k")) + 1).alias("n"))
    if residual:
        own = tokens.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("q")).select(*keys, "q", F.col("q").alias("k"), F.lit(1.0).alias("w"))
        w = w.unionByName(own).groupBy(*keys, "q", "k").agg(F.sum("w").alias("w"))
    w = _rows_to_one(w)
    if discard <= 0:
        return w
    w = written(w, "weights")
    tokens = w.groupBy(*keys).agg((F.max(F.greatest("q", "k")) + 1).alias("n"))
    missing = w.groupBy(*keys).count().join(tokens, keys).select(*keys, F.lit(0.0).alias("w"), (F.col("n") * F.col("n") - F.col("count")).alias("times")).filter("times > 0")
    values = w.select(*keys, "w", F.lit(1).cast("long").alias("times")).unionByName(missing)
    limits = percentiles(values, "w", [1 - discard], keys, times="times").select(*keys, F.get("ps", F.lit(0)).alias("__t"))
    return _rows_to_one(w.join(limits, keys).filter(F.col("w") >= F.col("__t")).drop("__t"))


def rollout(attention: DataFrame, discard: float = 0.0, residual: bool = True, starts: Column | None = None) -> DataFrame:
    """(image_id, q, k, w): rows of the product over layers, in order, of their ``rollout_weights``, which are written to the shared
    folder. Only the rows wanted (``starts`` on q; the class token's, if None) go through the layers, each by a join and a
    sum, so no matrix is ever made and nothing but the weights grows with the square of the tokens. An image without some
    layer ends there; weights that come to nothing have no row."""
    weights = written(rollout_weights(attention, discard, residual), "rollout")
    layers = sorted(r[0] for r in weights.select("layer").distinct().collect())
    first = (F.col("q") == 0) if starts is None else starts
    row = None
    for layer in layers:
        step = weights.filter(F.col("layer") == layer).drop("layer")
        if row is None:
            row = step.filter(first)
            continue
        step = step.select("image_id", F.col("q").alias("__on"), F.col("k").alias("__k"), F.col("w").alias("__w"))
        joined = row.withColumnRenamed("k", "__on").join(step, ["image_id", "__on"])
        row = joined.groupBy("image_id", "q", F.col("__k").alias("k")).agg(F.sum(F.col("w") * F.col("__w")).alias("w"))
    return weights.limit(0).drop("layer") if row is None else row.select("image_id", "q", "k", "w")


def cls_row(matrix: DataFrame, width: int) -> DataFrame:
    """The first token's weights on the patches, as grid cells; a patch without weight has no row."""
    return with_grid(matrix.filter("q = 0 AND k > 0").select("image_id", (F.col("k") - 1).alias("idx"), F.col("w").alias("score")), width)


def softmax_attention(qk: DataFrame, dim: int) -> DataFrame:
    """w = softmax over k of score / sqrt(dim) from (image_id, layer, head, q, k, score)."""
    keys = Window.partitionBy("image_id", "layer", "head", "q")
    z = F.col("score") / float(dim) ** 0.5
    e = F.exp(z - F.max(z).over(keys))
    return qk.withColumn("w", e / F.sum(e).over(keys)).drop("score")


def cell_stats(df: DataFrame, value: str = "score") -> DataFrame:
    """Per grid cell over reference images: mean and sample std + 1e-5 (1e-5 for one image)."""
    return df.groupBy("row", "col").agg(F.avg(value).alias("mu"), (F.coalesce(F.stddev_samp(value), F.lit(0.0)) + 1e-5).alias("sigma"))


def cell_deviation(df: DataFrame, stats: DataFrame, value: str = "score") -> DataFrame:
    """|x - mu| / sigma of the cell, as ``deviation``. The grid's statistics are as small as one image."""
    return df.join(F.broadcast(stats), ["row", "col"]).withColumn("deviation", F.abs(F.col(value) - F.col("mu")) / F.col("sigma")).drop("mu", "sigma")


def mahalanobis(df: DataFrame, reference: DataFrame, keys: tuple[str, ...] = ("image_id", "row", "col")) -> DataFrame:
    """(keys, score): diagonal Mahalanobis distance to the cell's reference mean, with sample variance + 1e-5."""
    parts = reference.select("row", "col", F.posexplode("features").alias("dim", "x"))
    facts = parts.groupBy("row", "col", "dim").agg(F.avg("x").alias("m"), (F.coalesce(F.var_samp("x"), F.lit(0.0)) + 1e-5).alias("v"))
    cells = facts.groupBy("row", "col").agg(F.array_sort(F.collect_list(F.struct("dim", "m", "v"))).alias("s"))
    term = F.zip_with("features", "s", lambda x, s: (x - s["m"]) * (x - s["m"]) / s["v"])
    return df.join(F.broadcast(cells), ["row", "col"]).select(*keys, F.sqrt(F.aggregate(term, F.lit(0.0), lambda a, b: a + b)).alias("score"))


def mean_vector(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The mean of ``features`` as an array (``prototype``)."""
    parts = df.select(*keys, F.posexplode("features").alias("dim", "x")).groupBy(*keys, "dim").agg(F.avg("x").alias("x"))
    return parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("prototype"))
