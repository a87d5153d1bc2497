"""Calibration of distances and score modes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from .order import percentiles

#: Levels of a calibration's percentile map.
PERCENTILES = (50.0, 75.0, 90.0, 95.0, 97.5, 99.0, 99.5)


def _at(i: int) -> Column:
    return F.get("ps", F.lit(i))


def summary(scores: DataFrame, levels: Sequence[float] = PERCENTILES, score: str = "score") -> DataFrame:
    """One row: n, mean, population std, median, IQR, and the percentile map (exact, linear)."""
    facts = scores.agg(F.count(score).alias("n"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"))
    ps = percentiles(scores, score, [0.5, 0.25, 0.75, *(q / 100 for q in levels)])
    names = F.array(*[F.lit(float(q)) for q in levels])
    cuts = ps.select(_at(0).alias("median"), (_at(2) - _at(1)).alias("iqr"), F.map_from_arrays(names, F.slice("ps", 4, len(levels))).alias("percentiles"))
    return facts.crossJoin(F.broadcast(cuts))


def threshold_at(scores: DataFrame, level: float, stored: DataFrame | None = None, score: str = "score") -> DataFrame:
    """One row ``threshold``: the stored percentile if there is one, else computed."""
    fresh = percentiles(scores, score, [level / 100]).select(_at(0).alias("fresh"))
    if stored is None:
        return fresh.select(F.col("fresh").alias("threshold"))
    return fresh.crossJoin(stored.select("percentiles")).select(F.coalesce(F.try_element_at("percentiles", F.lit(float(level))), "fresh").alias("threshold"))


def robust(scores: DataFrame, score: str = "score", keys: Sequence[str] = ()) -> DataFrame:
    """Median and IQR per key; an IQR of 1e-12 or less counts as 1."""
    iqr = _at(2) - _at(1)
    return percentiles(scores, score, [0.5, 0.25, 0.75], keys).select(*keys, _at(0).alias("median"), F.when(iqr <= 1e-12, 1.0).otherwise(iqr).alias("iqr"))


def stats(scores: DataFrame, score: str = "score", keys: Sequence[str] = ()) -> DataFrame:
    facts = scores.groupBy(*keys).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"))
    cuts = percentiles(scores, score, [0.5, 0.25, 0.75, 0.95], keys).select(*keys, *[_at(i).alias(n) for i, n in enumerate(("median", "q1", "q3", "p95"))])
    return facts.join(cuts, list(keys)) if keys else facts.crossJoin(F.broadcast(cuts))


def per_image(df: DataFrame, facts: dict[str, Column], image: str = "image_id") -> DataFrame:
    """Joins per-image aggregates: an aggregation combines before its shuffle, which a window over the same rows can't."""
    return df.join(df.groupBy(image).agg(*[c.alias(n) for n, c in facts.items()]), image)


def z_score(df: DataFrame, score: str = "score", image: str = "image_id") -> DataFrame:
    """(v - mean) / (population std + 1e-8) of each image, as ``z``."""
    rows = per_image(df, {"__m": F.avg(score), "__s": F.stddev_pop(score)}, image)
    return rows.withColumn("z", (F.col(score) - F.col("__m")) / (F.col("__s") + 1e-8)).drop("__m", "__s")


def iqr_score(df: DataFrame, factor: float = 1.5, score: str = "score", image: str = "image_id") -> DataFrame:
    """((v - q3) / (iqr + 1e-8)) / factor of each image, as ``iqr_score``."""
    rows = per_image(df, {"__1": F.percentile(score, F.lit(0.25)), "__3": F.percentile(score, F.lit(0.75))}, image)
    return rows.withColumn("iqr_score", (F.col(score) - F.col("__3")) / (F.col("__3") - F.col("__1") + 1e-8) / factor).drop("__1", "__3")


def percentile_score(df: DataFrame, level: float = 95.0, score: str = "score", image: str = "image_id") -> DataFrame:
    """max(v - p, 0) over its largest value in the image (0 where that is 0), as ``percentile_score``."""
    rows = per_image(df, {"__p": F.percentile(score, F.lit(level / 100)), "__t": F.max(score)}, image)
    over = F.greatest(F.col(score) - F.col("__p"), F.lit(0.0))
    return rows.withColumn("percentile_score", F.coalesce(ratio(over, F.greatest(F.col("__t") - F.col("__p"), F.lit(0.0))), F.lit(0.0))).drop("__p", "__t")


def score_mode(df: DataFrame, mode: str, facts: DataFrame | None = None, score: str = "score", **params) -> DataFrame:
    """``mode_score`` by mode: raw, zscore, iqr or percentile. With calibration ``facts`` (a row with mean and std of a reference)
    every mode starts from (score - mean) / (std + 1e-8), and zscore is just that; without, zscore is the image's own."""
    made = {"zscore": (z_score, "z"), "iqr": (iqr_score, "iqr_score"), "percentile": (percentile_score, "percentile_score")}
    if mode != "raw" and mode not in made:
        raise ValueError(f"unknown score mode {mode}")
    rows = df.withColumn("__v", F.col(score).cast("double"))
    if facts is not None:
        rows = rows.crossJoin(F.broadcast(facts.select(F.col("mean").alias("__m"), F.col("std").alias("__s")))).withColumn("__v", (F.col(score) - F.col("__m")) / (F.col("__s") + 1e-8)).drop("__m", "__s")
    if mode == "raw" or mode == "zscore" and facts is not None:
        return rows.withColumn("mode_score", F.col("__v")).drop("__v")
    f, name = made[mode]
    return f(rows, score="__v", **params).withColumnRenamed(name, "mode_score").drop("__v")
