"""Text exports of pixels and shapes, written by Spark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fusion_rows(px: DataFrame, channels: Sequence[int]) -> DataFrame:
    """row, col (from 1) and one value column per channel; missing ones are 0."""
    cols = [F.coalesce(F.max(F.when(F.col("channel_id") == c, F.col("value"))), F.lit(0.0)).alias(f"v{c}") for c in channels]
    return px.groupBy("y", "x").agg(*cols).select((F.col("y") + 1).cast("int").alias("row"), (F.col("x") + 1).cast("int").alias("col"), *(f"v{c}" for c in channels))


def fusion_text(px: DataFrame, channels: Sequence[int]) -> DataFrame:
    """row, col, line: two decimals, commas between and at the end."""
    rows = fusion_rows(px, channels)
    line = F.concat(F.concat_ws(",", F.col("row").cast("string"), F.col("col").cast("string"), *(F.format_string("%.2f", f"v{c}") for c in channels)), F.lit(","))
    return rows.select("row", "col", line.alias("line"))


def write_fusion(px: DataFrame, path: str, channels: Sequence[int], names: Sequence[str]) -> None:
    """Lines with rows running fastest; a header leads the first file."""
    lines = fusion_text(px, channels)
    head = lines.sparkSession.createDataFrame([(0, 0, ",".join(["row", "col", *names]) + ",")], lines.schema)
    lines.unionByName(head).orderBy("col", "row").select("line").write.mode("ignore").text(path)


def feature_lines(nested: DataFrame) -> DataFrame:
    """shape_idx, feature: one GeoJSON polygon a row, rings closed, of nested shapes."""
    closed = F.when(F.element_at("vertices", 1) == F.element_at("vertices", -1), F.col("vertices")).otherwise(F.concat("vertices", F.slice("vertices", 1, 1)))
    ring = F.transform(closed, lambda v: F.array(v["x"].cast("double"), v["y"].cast("double")))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    props = F.struct(F.struct(F.col("shape_name").alias("name")).alias("classification"))
    return nested.select("shape_idx", F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), props.alias("properties"))).alias("feature"))


def write_geojson(nested: DataFrame, path: str) -> None:
    """Features as lines, which GeoJSON readers take as a sequence."""
    feature_lines(nested).orderBy("shape_idx").select("feature").write.mode("ignore").text(path)
