"""The model's tables from the tables at hand: a coordinate image, points, shapes and spectra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, CHANNELS = 25, 64
#: A polygon and a concave one over the image, x, y.
POLYGON = ((3.0, 2.0), (17.0, 4.0), (20.0, 13.0), (9.0, 17.0), (2.0, 10.0))
CONCAVE = ((1.0, 1.0), (23.0, 1.0), (23.0, 18.0), (12.0, 6.0), (1.0, 18.0))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y, x, vec_id, label, embedding: a pixel per row, a channel per element."""
    e = load(spark, sf_dir, "embeddings")
    return e.select((F.col("vec_id") / WIDTH).cast("int").alias("y"), (F.col("vec_id") % WIDTH).cast("int").alias("x"), "vec_id", "label", "embedding")


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y, x, channel_id, value."""
    from slidespark.operators.pixels import explode_channels

    return explode_channels(matrix(spark, sf_dir), "embedding", "y", "x")


def channel(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    from slidespark.operators.pixels import select_channel

    return select_channel(matrix(spark, sf_dir), "embedding", k, "y", "x")


def height(spark: SparkSession, sf_dir: str) -> int:
    """Up to the last pixel, whichever are missing before it."""
    last = load(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0]
    return 0 if last is None else last // WIDTH + 1


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slidespark.operators.vectors import vertices as build

    e = load(spark, sf_dir, "events")
    return build(e.select(F.col("user_id").cast("string").alias("cell"), F.col("value").alias("vertex_x"), (F.col("event_id") % 101).cast("double").alias("vertex_y"), "event_id"), ["event_id"])


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame"), F.col("l_extendedprice").alias("mz"), F.col("l_quantity").alias("intensity"))


#: The same tables in SQL.
SQL_MATRIX = "m AS (SELECT CAST(vec_id // 25 AS INTEGER) AS y, CAST(vec_id % 25 AS INTEGER) AS x, vec_id, label, embedding FROM embeddings)"
SQL_PX = "px AS (SELECT CAST(vec_id // 25 AS INTEGER) AS y, CAST(vec_id % 25 AS INTEGER) AS x, CAST(i - 1 AS INTEGER) AS channel_id, CAST(embedding[i] AS DOUBLE) AS value, vec_id, label FROM embeddings, range(1, 65) t(i))"


def sql_inside(polygon, x: str, y: str) -> str:
    """Crossing-number test in SQL."""
    parts = [
        f"CASE WHEN (({y1} > {y}) <> ({y2} > {y})) AND {x} < ({x2 - x1}) * ({y} - ({y1})) / CAST({y2 - y1} AS DOUBLE) + ({x1}) THEN 1 ELSE 0 END"
        for (x1, y1), (x2, y2) in zip(polygon, (*polygon[1:], polygon[0]), strict=True)
        if y1 != y2
    ]
    return "((" + " + ".join(parts) + ") % 2 = 1)"
