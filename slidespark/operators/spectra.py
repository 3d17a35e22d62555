"""Ion images from spectra (frame, mz, intensity)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pixels import few


def extract(spectra: DataFrame, targets: Sequence[float], ppm: float = 10.0) -> DataFrame:
    """target, frame, intensity: sums of peaks within ppm of each target.

    Targets are cut to buckets as wide as the widest window, so a peak looks at the windows of its own bucket and of two
    neighbours through an equi-join; there is no range join over all peaks.
    """
    spark = spectra.sparkSession
    half = max(targets) * ppm * 1e-6
    width = max(2 * half, 1e-9)
    windows = spark.createDataFrame([(float(t),) for t in targets], "target double").withColumn("delta", F.col("target") * F.lit(ppm * 1e-6))
    home = F.floor(F.col("target") / width)
    windows = windows.withColumn("bucket", F.explode(F.array(home - 1, home, home + 1)))
    hit = spectra.withColumn("bucket", F.floor(F.col("mz") / width)).join(few(windows), "bucket")
    inside = hit.where((F.col("mz") >= F.col("target") - F.col("delta")) & (F.col("mz") <= F.col("target") + F.col("delta")))
    return inside.groupBy("target", "frame").agg(F.sum("intensity").alias("intensity"))


def split_regions(frames: DataFrame, region: str = "region") -> DataFrame:
    """Pixels of each region moved to its own origin."""
    low = frames.groupBy(region).agg(F.min("x").alias("_x"), F.min("y").alias("_y"))
    return frames.join(few(low), region).withColumns({"x": (F.col("x") - F.col("_x")).cast("int"), "y": (F.col("y") - F.col("_y")).cast("int")}).drop("_x", "_y")
