"""Windowed counts and sums of events with a watermark, alike for streams and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, in the schema of those that are there."""
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def tumbling(events: DataFrame, time: str, width: str, keys: list[str], value: str, late: str = "1 hour") -> DataFrame:
    """Columns window_start, keys, n, total. In a stream, windows close when the watermark has passed them."""
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark(time, late)
    grouped = timed.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.round(F.sum(value), 2).alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), *keys, "n", "total")
