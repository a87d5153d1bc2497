"""Masks and grids: run lengths, patch overlaps, labels, components, boxes. A mask is a table of runs or of pixels."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grid_shape(height: Column, width: Column, resolution: int = 448, patch: int = 14) -> dict[str, Column]:
    """Processed height and width (the short side becomes ``resolution``, the long one is rounded with halves to even, then
    both are cropped to whole patches) and grid rows and columns. Equal sides take the second branch."""
    short = height < width
    h = F.when(short, F.lit(resolution)).otherwise(F.bround(height * resolution / width, 0)).cast("long")
    w = F.when(short, F.bround(width * resolution / height, 0)).otherwise(F.lit(resolution)).cast("long")
    h, w = h - h % patch, w - w % patch
    return {"proc_height": h, "proc_width": w, "grid_rows": (h / patch).cast("long"), "grid_cols": (w / patch).cast("long")}


def rle_runs(annotations: DataFrame) -> DataFrame:
    """(image_id, class_id, start, length) with 0-based starts, from 1-based run-length text."""
    numbers = F.transform(F.split(F.trim("rle"), r"\s+"), lambda x: x.cast("long"))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(numbers) / 2).cast("int") - 1), lambda i: F.struct((F.get(numbers, 2 * i) - 1).alias("start"), F.get(numbers, 2 * i + 1).alias("length")))
    rows = annotations.filter(F.trim("rle") != "").select("image_id", "class_id", F.explode(pairs).alias("r"))
    return rows.select("image_id", "class_id", "r.start", "r.length").filter("length > 0")


def rle_pixels(annotations: DataFrame, height: int) -> DataFrame:
    """(image_id, class_id, px, y, x) of every mask pixel, column by column, each once."""
    runs = rle_runs(annotations)
    px = runs.select("image_id", "class_id", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("px")).distinct()
    return px.select("image_id", "class_id", "px", (F.col("px") % height).alias("y"), F.expr(f"px div {height}").alias("x"))


def rle_encode(pixels: DataFrame) -> DataFrame:
    """(image_id, class_id, rle) from pixels: neighbours in order of ``px`` form islands."""
    w = Window.partitionBy("image_id", "class_id").orderBy("px")
    rows = pixels.select("image_id", "class_id", "px", (F.col("px") - F.row_number().over(w)).alias("island"))
    runs = rows.groupBy("image_id", "class_id", "island").agg(F.min("px").alias("s"), F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("s", "n")))
    return runs.groupBy("image_id", "class_id").agg(F.array_join(F.transform(ordered, lambda r: F.concat_ws(" ", (r["s"] + 1).cast("string"), r["n"].cast("string"))), " ").alias("rle"))


def mask_union(pixels: DataFrame) -> DataFrame:
    return pixels.select("image_id", F.lit(0).alias("class_id"), "px", "y", "x").distinct()


def resized(pixels: DataFrame, height: int, width: int, new_height: int, new_width: int, crop_height: int, crop_width: int) -> DataFrame:
    """Nearest-neighbour resize then crop: a target pixel shows source floor(target * source size / target size)."""
    def targets(src: Column, old: int, new: int) -> Column:
        first = F.ceil(src * new / old).cast("long")
        stop = F.ceil((src + 1) * new / old).cast("long") - 1
        return F.filter(F.sequence(first - 1, stop + 1), lambda t: F.floor(t * old / new) == src)

    rows = pixels.select("image_id", "class_id", F.explode(targets(F.col("y"), height, new_height)).alias("y"), "x")
    rows = rows.select("image_id", "class_id", "y", F.explode(targets(F.col("x"), width, new_width)).alias("x"))
    return rows.filter((F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") < crop_height) & (F.col("x") < crop_width))


def patch_overlap(pixels: DataFrame, keys: DataFrame, rows: int, cols: int, patch: int) -> DataFrame:
    """(image_id, class_id, row, col, overlap) over the full grid of every (image_id, class_id) of ``keys``."""
    counts = pixels.groupBy("image_id", "class_id", F.expr(f"y div {patch}").alias("row"), F.expr(f"x div {patch}").alias("col")).agg(F.count("*").alias("n"))
    grid = keys.select("image_id", "class_id").distinct().select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rows - 1).cast("long"))).alias("row"))
    grid = grid.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cols - 1).cast("long"))).alias("col"))
    return grid.join(counts, ["image_id", "class_id", "row", "col"], "left").select("image_id", "class_id", "row", "col", (F.coalesce("n", F.lit(0)) / float(patch * patch)).alias("overlap"))


def patch_label(overlap: Column, rule: str, threshold: float = 0.5, center: Column | None = None) -> Column:
    """center_point, any_overlap (> 0), overlap_ratio_threshold (>=) or majority_vote (> 0.5)."""
    rules = {"any_overlap": overlap > 0, "overlap_ratio_threshold": overlap >= threshold, "majority_vote": overlap > 0.5}
    if rule == "center_point":
        return F.coalesce(center, F.lit(False))
    if rule not in rules:
        raise ValueError(f"unknown label rule {rule}")
    return rules[rule]


def center_hits(pixels: DataFrame, patch: int) -> DataFrame:
    """Patches whose centre pixel is in the mask."""
    mid = patch // 2
    hit = pixels.filter((F.col("y") % patch == mid) & (F.col("x") % patch == mid))
    return hit.select("image_id", "class_id", F.expr(f"y div {patch}").alias("row"), F.expr(f"x div {patch}").alias("col"), F.lit(True).alias("center"))


def patch_box(row: Column, col: Column, patch: int) -> Column:
    """[row, col, y1, x1, y2, x2] in pixels."""
    return F.array(row, col, row * patch, col * patch, (row + 1) * patch, (col + 1) * patch)


def multiclass_target(overlaps: DataFrame, threshold: float) -> DataFrame:
    """Per patch: ``binary`` from the union (class 0), ``multiclass`` the class (0-based) of largest overlap among those at or
    above the threshold, ties to the smaller, else -1."""
    ok = (F.col("class_id") > 0) & (F.col("overlap") >= threshold)
    return overlaps.groupBy("image_id", "row", "col").agg(
        F.max(F.when((F.col("class_id") == 0) & (F.col("overlap") >= threshold), 1.0).otherwise(0.0)).alias("binary"),
        F.coalesce(F.max_by(F.when(ok, F.col("class_id") - 1), F.when(ok, F.struct(F.col("overlap"), -F.col("class_id")))), F.lit(-1)).cast("int").alias("multiclass"),
    )


def patch_counts(runs: DataFrame, height: int, rows: int, cols: int, patch: int) -> DataFrame:
    """(image_id, class_id, row, col, n, center) of patches that runs (image_id, class_id, start, length) reach: their pixels, each once, and
    whether the centre pixel is one of them. Runs are cut where others began before and at the edges of patches, and never
    become pixels. All runs of an image and class are one group."""
    stop = F.col("start") + F.col("length")
    before = F.max("stop").over(Window.partitionBy("image_id", "class_id").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1))
    own = runs.select("image_id", "class_id", F.greatest("start", F.lit(0)).alias("start"), F.least(stop, F.lit(height * cols * patch)).alias("stop"))
    own = own.withColumn("start", F.greatest("start", before)).filter("start < stop")
    lines = own.select("*", F.explode(F.sequence(F.expr(f"start div {height}"), F.expr(f"(stop - 1) div {height}"))).alias("x"))
    top, end = F.greatest(F.col("start") - F.col("x") * height, F.lit(0)), F.least(F.col("stop") - F.col("x") * height, F.lit(rows * patch))
    lines = lines.select("image_id", "class_id", "x", top.alias("top"), end.alias("end")).filter("top < end")
    bits = lines.select("*", F.explode(F.sequence(F.expr(f"top div {patch}"), F.expr(f"(end - 1) div {patch}"))).alias("row"))
    n = F.least("end", (F.col("row") + 1) * patch) - F.greatest("top", F.col("row") * patch)
    mid = F.col("row") * patch + patch // 2
    center = (F.col("x") % patch == patch // 2) & (F.col("top") <= mid) & (F.col("end") > mid)
    return bits.groupBy("image_id", "class_id", "row", F.expr(f"x div {patch}").alias("col")).agg(F.sum(n).alias("n"), F.bool_or(center).alias("center"))


def patch_labels(annotations: DataFrame, images: DataFrame, height: int, width: int, patch: int, rule: str = "any_overlap", threshold: float = 0.5, resize: tuple[int, int] | None = None) -> DataFrame:
    """(image_id, class_id, row, col, overlap, label): run-length masks of ``height`` x ``width`` pixels, resized if asked for, as labels of
    every patch of every image and of each class that any mask has; class 0 is any of them. Images without masks have
    labels of false. Only masks to be resized become pixels."""
    runs = rle_runs(annotations)
    classes = runs.select("class_id").distinct().unionByName(annotations.sparkSession.createDataFrame([(0,)], "class_id int")).distinct()
    keys = images.select("image_id").distinct().join(F.broadcast(classes), F.lit(True))  # classes are a short list
    high, wide = resize or (height, width)
    rows, cols = high // patch, wide // patch
    if resize is None:
        counts = patch_counts(runs.unionByName(runs.withColumn("class_id", F.lit(0))), height, rows, cols, patch)
    else:
        px = rle_pixels(annotations, height)
        shown = resized(mask_union(px).unionByName(px), height, width, high, wide, rows * patch, cols * patch)
        counts = shown.groupBy("image_id", "class_id", F.expr(f"y div {patch}").alias("row"), F.expr(f"x div {patch}").alias("col")).agg(F.count("*").alias("n"), F.bool_or((F.col("y") % patch == patch // 2) & (F.col("x") % patch == patch // 2)).alias("center"))
    # a grid is one row until it has been joined, and its patches without pixels are the places that are left
    place = (F.col("row") * cols + F.col("col")).cast("long").alias("place")
    grids = counts.groupBy("image_id", "class_id").agg(F.collect_list(F.struct(place, F.col("n").cast("long").alias("n"), "center")).alias("found"))
    every = F.sequence(F.lit(0).cast("long"), F.lit(rows * cols - 1).cast("long"))
    found = F.coalesce("found", F.array().cast("array<struct<place: bigint, n: bigint, center: boolean>>"))
    none = F.transform(F.array_except(every, F.transform(found, lambda c: c["place"])), lambda i: F.struct(i.alias("place"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("center")))
    cells = keys.join(grids, ["image_id", "class_id"], "left").select("image_id", "class_id", F.inline(F.concat(found, none)))
    overlap = F.col("n") / float(patch * patch)
    cells = cells.select("image_id", "class_id", F.expr(f"place div {cols}").alias("row"), (F.col("place") % cols).alias("col"), overlap.alias("overlap"), "center")
    return cells.select("image_id", "class_id", "row", "col", "overlap", patch_label(F.col("overlap"), rule, threshold, F.col("center")).alias("label"))


def _label(r: np.ndarray, c: np.ndarray, eight: bool) -> np.ndarray:
    """Component numbers of cells of one image, by least label with pointer jumping."""
    place = {(a, b): i for i, (a, b) in enumerate(zip(r.tolist(), c.tolist()))}
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if eight else [])
    edges = [(i, j) for (a, b), i in place.items() for da, db in steps if (j := place.get((a + da, b + db))) is not None]
    label = np.arange(len(r))
    if not edges:
        return label
    x, y = np.array(edges).T
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def components(cells: DataFrame, connectivity: int = 8, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """``cells`` (keys, row, col) with ``component``, numbered from 0 by first cell in row order. An image's grid is one group."""
    if connectivity not in (4, 8):
        raise ValueError("connectivity is 4 or 8")
    schema = ", ".join(f"{n} {t}" for n, t in cells.select(*keys, "row", "col").dtypes) + ", component int"

    def one(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by([("row", "ascending"), ("col", "ascending")])
        found = _label(t.column("row").to_numpy(), t.column("col").to_numpy(), connectivity == 8)
        return t.append_column("component", pa.array(np.unique(found, return_inverse=True)[1].astype(np.int32)))

    return cells.select(*keys, "row", "col").distinct().groupBy(*keys).applyInArrow(one, schema)


def component_boxes(parts: DataFrame, patch: int, scale_y: float, scale_x: float, min_area: int = 1) -> DataFrame:
    """Boxes in native pixels of components of at least ``min_area`` patches, with centres."""
    box = parts.groupBy("image_id", "component").agg(F.count("*").alias("area"), *[f(c).alias(f"{n}_{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in ("row", "col")])
    box = box.filter(F.col("area") >= min_area)
    y1, x1 = F.col("lo_row") * patch * scale_y, F.col("lo_col") * patch * scale_x
    y2, x2 = (F.col("hi_row") + 1) * patch * scale_y, (F.col("hi_col") + 1) * patch * scale_x
    return box.select("image_id", "component", "area", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), ((x1 + x2) / 2).alias("cx"), ((y1 + y2) / 2).alias("cy"))


def spatial_cleanup(df: DataFrame, least: int) -> DataFrame:
    """Rejected patches of 4-connected components smaller than ``least`` are kept again (``keep`` is changed)."""
    parts = components(df.filter(~F.col("keep")), 4)
    sizes = parts.groupBy("image_id", "component").agg(F.count("*").alias("__n"))
    small = parts.join(sizes, ["image_id", "component"]).filter(F.col("__n") < least).select("image_id", "row", "col", F.lit(True).alias("__back"))
    return df.join(small, ["image_id", "row", "col"], "left").withColumn("keep", F.col("keep") | F.coalesce("__back", F.lit(False))).drop("__back")


def upsample(cells: DataFrame, factor: int) -> DataFrame:
    """Nearest repetition of grid cells to pixels."""
    rows = cells.withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(factor - 1)))).withColumn("__j", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))
    return rows.withColumn("y", F.col("row") * factor + F.col("__i")).withColumn("x", F.col("col") * factor + F.col("__j")).drop("__i", "__j")


def gaussian(sigma: float) -> list[float]:
    """Weights of a smoothing kernel, cut at four sigmas."""
    r = int(4 * sigma + 0.5)
    w = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-r, r + 1)]
    return [x / sum(w) for x in w]
