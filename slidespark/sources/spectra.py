"""Spectral imaging sources: total ion counts by pixel of imzML files and of Bruker (SQLite) acquisitions."""

from __future__ import annotations

import os
import sqlite3
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slidespark.operators.spectra import split_regions
from slidespark.session import ship

from . import imzml

FRAME = "frame long, region int, x int, y int, intensity double, spot double"


def read_imzml(spark: SparkSession, path: str) -> tuple[DataFrame, list[str], float]:
    """Total ion counts; for ion images see imzml.ion_images."""
    return imzml.index(spark, path).select("y", "x", F.lit(0).alias("channel_id"), F.col("total").alias("value")), ["tic"], 1.0


def _bruker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    query = """SELECT i.Frame, i.RegionNumber, i.XIndexPos, i.YIndexPos, f.SummedIntensities, l.SpotSize FROM MaldiFrameInfo i
        LEFT JOIN Frames f ON f.Id = i.Frame LEFT JOIN MaldiFrameLaserInfo l ON l.Id = i.LaserInfo"""
    for b in batches:
        for content in b.column(0).to_pylist():
            with tempfile.TemporaryDirectory() as d:
                with open(os.path.join(d, "a"), "wb") as f:
                    f.write(content)
                with sqlite3.connect(os.path.join(d, "a")) as db:
                    rows = db.execute(query).fetchall()
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], [c.split()[0] for c in FRAME.split(", ")])


def bruker_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frames with their region, pixel, summed intensity and spot size, joined by frame number."""
    ship(spark)
    at = f"{path.rstrip('/')}/analysis.t[sd]f" if path.rstrip("/").endswith(".d") else path
    return spark.read.format("binaryFile").load(at).select("content").mapInArrow(_bruker, FRAME)


def read_bruker(spark: SparkSession, path: str) -> tuple[DataFrame, list[str], float]:
    frames = bruker_frames(spark, path)
    low = frames.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("spot").alias("spot")).first()
    out = frames.select((F.col("y") - low["y0"]).alias("y"), (F.col("x") - low["x0"]).alias("x"), F.lit(0).alias("channel_id"), F.col("intensity").alias("value"))
    return out, ["tic"], low["spot"] or 1.0


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """Frames with each region at its own origin."""
    return split_regions(bruker_frames(spark, path))
