"""Streaming extension (no counterpart in the reference's operators): a fitted bank scores a stream, and windows count errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet", files_per_trigger: int = 1) -> DataFrame:
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def thresholded(stream: DataFrame, threshold: float, score: str = "value") -> DataFrame:
    """Adds ``flag``: score >= threshold."""
    return stream.withColumn("flag", F.col(score) >= threshold)


def error_rates(stream: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Per tumbling window: events, flagged ones and their share; state of windows older than the watermark is dropped."""
    groups = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window))
    rows = groups.agg(F.count("*").alias("n"), F.count_if("flag").alias("flagged"))
    return rows.select(F.col("window.start").alias("start"), "n", "flagged", (F.col("flagged") / F.col("n")).alias("rate"))


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs what is there to the end and gives the result table; for tests and catch-up runs."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
