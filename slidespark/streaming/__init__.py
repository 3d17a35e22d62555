"""Streaming ingest: files that arrive in a folder become pixels or running summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pixel_stream(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """Parquet files of pixels (y, x, channel_id, value) in a folder, as they come."""
    return spark.readStream.schema("y int, x int, channel_id int, value double").option("maxFilesPerTrigger", per_trigger).parquet(path)


def channel_summary(pixels: DataFrame) -> DataFrame:
    """Running count, range and sum of each channel; state is one row per channel."""
    return pixels.groupBy("channel_id").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.sum("value").alias("total"))


def event_windows(events: DataFrame, ts: str = "ts", minutes: int = 60, late: int = 10) -> DataFrame:
    """Counts and sums of events per window and type; windows close once the watermark passes."""
    return events.withWatermark(ts, f"{late} minutes").groupBy(F.window(ts, f"{minutes} minutes"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def write_files(stream: DataFrame, path: str, checkpoint: str):
    """Append pixels to Parquet, partitioned by channel; files are committed with the batch."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("channel_id").trigger(availableNow=True).start()
