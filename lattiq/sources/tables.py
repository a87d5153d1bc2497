"""Test tables as the views of the data model: patch features, patch scores, image facts, event grids, runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import doubles

ANNOTATION = T.StructType([T.StructField("image_id", T.StringType()), T.StructField("class_id", T.IntegerType()), T.StructField("rle", T.StringType())])
#: Rows and columns of the images that ``annotations`` are masks of.
MASK_SIDE = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def patch_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty vectors per image on a grid of 4 by 5; labels 6 to 9 are defect classes 1 to 4."""
    group = F.expr("(vec_id div 20) % 5")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.expr("vec_id div 20").alias("image_id"),
        F.expr("(vec_id % 20) div 5").alias("row"),
        (F.col("vec_id") % 5).alias("col"),
        doubles(F.col("embedding")).alias("features"),
        F.greatest(F.col("label") - 5, F.lit(0)).alias("class_id"),
        (F.col("label") >= 6).alias("is_defect"),
        F.when(group == 0, "query").when(group.isin(1, 2) & (F.col("label") < 6), "clean").when(group.isin(3, 4), "candidate").otherwise("unused").alias("role"),
    )


def patch_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order = image, line = patch; the score carries a signal of the label."""
    hit = F.col("l_returnflag") == "R"
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("image_id"),
        F.round(F.col("l_quantity") / 50.0 + 0.3 * F.when(hit, 1).otherwise(0) * F.col("l_discount") * 10, 6).alias("score"),
        hit.alias("is_defect"),
        F.when(hit, F.col("l_linenumber") % 4 + 1).otherwise(0).alias("class_id"),
        (F.col("l_linestatus") == "O").alias("valid"),
    )


def event_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User = image, order of events = cell of a grid of eight columns."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    rows = table(spark, sf_dir, "events").withColumn("n", n)
    return rows.select(F.col("user_id").alias("image_id"), "event_id", F.expr("n div 8").cast("long").alias("row"), (F.col("n") % 8).cast("long").alias("col"), F.col("value").alias("score"), (F.col("event_type") == "error").alias("is_defect"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    keys = [F.col("l_returnflag").alias("condition"), F.col("l_linenumber").alias("seed"), F.lit(0).alias("fold")]
    return rows.groupBy(*keys).agg(F.round(F.avg("l_discount"), 6).alias("auprc"), F.round(F.avg("l_tax"), 6).alias("auroc"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-length masks (1-based starts and lengths, column by column) of images of ``MASK_SIDE`` rows and columns: user = image,
    id of the event modulo 4 = class, each event a run from a place given by its value; every seventh user has a mask
    without runs, too."""
    rows = table(spark, sf_dir, "events")
    start = F.pmod(F.floor(F.abs("value") * 40).cast("long"), F.lit(4000))
    runs_ = rows.select(F.col("user_id").alias("image_id"), (F.col("event_id") % 4 + 1).cast("int").alias("class_id"), F.struct(start.alias("s"), (F.col("event_id") % 37 + 1).alias("n")).alias("r"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: F.concat_ws(" ", (r["s"] + 1).cast("string"), r["n"].cast("string"))), " ")
    masks = runs_.groupBy("image_id", "class_id").agg(text.alias("rle"))
    blank = rows.filter("user_id % 7 = 0").select(F.col("user_id").alias("image_id")).distinct()
    none = F.when(F.col("image_id") % 3 == 1, "").when(F.col("image_id") % 3 == 2, " NaN ")
    return masks.unionByName(blank.select("image_id", F.lit(5).alias("class_id"), none.alias("rle")))
