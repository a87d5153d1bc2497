"""Sinks: JSON, CSV and Parquet reports."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite
from ..operators.order import ranked


def nulls_for_nan(df: DataFrame) -> DataFrame:
    return df.withColumns({c: finite(F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def write_json(df: DataFrame, path: str) -> None:
    """NaN and infinities become null; null fields are written."""
    nulls_for_nan(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    return df.withColumns({c: F.to_json(c) for c, t in df.dtypes if t.startswith(("struct", "array", "map"))})


def write_csv(frames: Sequence[DataFrame], path: str) -> None:
    """Rows of all frames under the union of their columns."""
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f, allowMissingColumns=True)
    flat(nulls_for_nan(rows)).write.mode("overwrite").option("header", "true").csv(path)


def write_report(report: DataFrame, runs: DataFrame, deltas: DataFrame, folder: str) -> None:
    write_json(report, f"{folder}/report.json")
    write_csv([runs], f"{folder}/runs.csv")
    write_csv([deltas], f"{folder}/deltas.csv")


def write_history(spark: SparkSession, records: Sequence[Mapping], folder: str, formats: Sequence[str] = ("json", "csv")) -> None:
    """A training history, one record an epoch, in order: ``history.json`` (a line each, NaN as null) and ``history.csv`` under all
    keys in order of their first use, floats with eight digits, nothing for null and NaN."""
    keys = list(dict.fromkeys(k for r in records for k in r))
    clean = [{k: None if isinstance(r.get(k), float) and not math.isfinite(r[k]) else r.get(k) for k in keys} for r in records]
    if "json" in formats:
        lines = [(i, json.dumps({k: c[k] for k in r})) for i, (r, c) in enumerate(zip(records, clean))]
        spark.createDataFrame(lines, "i int, value string").coalesce(1).sortWithinPartitions("i").select("value").write.mode("overwrite").text(f"{folder}/history.json")
    if "csv" in formats:
        text = lambda v: "" if v is None else f"{v:.8g}" if isinstance(v, float) else str(v)
        rows = [(i, *[text(c[k]) for k in keys]) for i, c in enumerate(clean)]
        cells = spark.createDataFrame(rows, ", ".join(["`__i` int", *[f"`{k}` string" for k in keys]])) if keys else spark.createDataFrame([], "`__i` int, `empty` string")
        cells.coalesce(1).sortWithinPartitions("__i").drop("__i").write.mode("overwrite").option("header", "true").option("emptyValue", "").csv(f"{folder}/history.csv")


def write_bundle(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Score, rejection or selection bundles, and per-scorer outputs (``by`` = scorer, layer)."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def measurements(df: DataFrame) -> DataFrame:
    """Object, sample, score, bank time and inference time with five decimals."""
    return df.select("object", "sample", *[F.format_string("%.5f", F.col(c)).alias(c) for c in ("score", "bank_time", "inference_time")])


def ordered_columns(df: DataFrame, preferred: Sequence[str]) -> DataFrame:
    first = [c for c in preferred if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])


def gap_csv(runs: DataFrame, oracle: str, auto: str, metrics: Sequence[str], path: str, keys: Sequence[str] = ("fold", "seed")) -> None:
    """The differences between the oracle's and the automatic condition's runs as one CSV table: keys, metric, both values, gap."""
    o, a = (runs.filter(F.col("condition") == c).unpivot(list(keys), list(metrics), "metric", n) for c, n in ((oracle, "oracle"), (auto, "auto")))
    rows = o.join(a, [*keys, "metric"]).withColumn("gap", F.col("oracle") - F.col("auto"))
    rows.orderBy(*keys, "metric").coalesce(1).write.mode("overwrite").csv(path, header=True)  # one row a run and metric


def merge_rows(prior: DataFrame, new: DataFrame, key: str = "name") -> DataFrame:
    """Rows by name: new values replace old ones in their old place, new names follow in their order (column ``ord``)."""
    latest = new.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ord")))).filter("__n = 1").drop("__n")
    kept = prior.join(latest, key, "left_anti").withColumn("__late", F.lit(0))
    place = prior.select(key, F.col("ord").alias("__old"))
    put = latest.join(place, key, "left").withColumn("__late", F.col("__old").isNull().cast("int")).withColumn("ord", F.coalesce("__old", "ord")).drop("__old")
    merged = kept.unionByName(put, allowMissingColumns=True).withColumnRenamed("ord", "__was")
    return ranked(merged, [F.col("__late"), F.col("__was"), F.col(key)], name="ord").withColumn("ord", F.col("ord").cast("int")).drop("__late", "__was")
