"""Delimited and Parquet tables of points or shape vertices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slidespark.operators import vectors
from slidespark.plans.catalog import Dataset, dataset_key


def delimited(spark: SparkSession, path: str) -> DataFrame:
    """Columns separated by tabs, commas or single spaces, whichever the first line has; row numbers keep the files' order."""
    if path.lower().endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        head = spark.read.text(path).first()
        line = head[0] if head else ""
        sep = next((s for s in ("\t", ",", " ") if s in line), ",")
        df = spark.read.csv(path, header=True, inferSchema=True, sep=sep)
    return df.withColumn("_row", F.monotonically_increasing_id())


def looks_like_shapes(df: DataFrame) -> bool:
    return vectors.has_columns(df, (), (vectors.VERTEX_X, vectors.VERTEX_Y, vectors.GROUPS))


def read(spark: SparkSession, path: str) -> Dataset:
    df = delimited(spark, path)
    if looks_like_shapes(df):
        return Dataset(dataset_key(path), path, vectors.vertices(df, ["_row"]), "shapes")
    return Dataset(dataset_key(path), path, vectors.points(df).drop("_row"), "points")
