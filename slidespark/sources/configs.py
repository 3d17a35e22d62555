"""Stored registrations: JSON or TOML documents with matrices, image shapes and pixel sizes, as a typed and checked table."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slidespark.functions.geometry import matrix_key
from slidespark.session import ship

_PATHS = "ARRAY<STRUCT<path: STRING, pixel_size_um: DOUBLE, image_shape: ARRAY<INT>>>"
KEYS = tuple(matrix_key(yx, px, inverse) for yx in (True, False) for px in (True, False) for inverse in (False, True))
#: The fields of a registration document that are read.
SCHEMA = f"schema_version STRING, tool STRING, time_created STRING, transformation_type STRING, fixed_paths {_PATHS}, moving_paths {_PATHS}, " + ", ".join(
    f"{k} ARRAY<ARRAY<DOUBLE>>" for k in ("fixed_points_yx_px", "fixed_points_yx_um", "moving_points_yx_px", "moving_points_yx_um", *KEYS)
)


class ConfigError(ValueError):
    """A registration document that cannot be used."""


def _from_toml(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.assign(text=[json.dumps(tomllib.loads(t), default=str) for t in b["text"]])


def documents(spark: SparkSession, path: str) -> DataFrame:
    """path, text of the documents at a path or pattern; TOML is turned into JSON."""
    ship(spark)
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    toml = F.lower("path").endswith(".toml")
    return files.where(~toml).unionByName(files.where(toml).mapInPandas(_from_toml, "path string, text string"))


def _one(paths: Column, value, what: str) -> tuple[Column, Column]:
    """The value that all images of a side agree on, and what is wrong if they do not."""
    found = F.array_distinct(F.transform(paths, value))
    wrong = F.when(F.coalesce(F.size(paths), F.lit(0)) < 1, f"no {what}").when(F.size(found) > 1, f"different {what}").when(found[0].isNull(), f"no {what}")
    return F.get(found, F.lit(0)), wrong


def registrations(docs: DataFrame, yx: bool = True, px: bool = True, inverse: bool = False, text: str = "text", strict: bool = False) -> DataFrame:
    """The columns of docs but the text, and m00 .. m22, fixed_height, fixed_width, fixed_um, the same of moving, and problem.

    problem says what is wrong with a document: no JSON, no such matrix or one that is not 3 x 3, or images of one side that
    have no or different shapes or pixel sizes; its values are null then.  With strict, it is an error.
    """
    key = matrix_key(yx, px, inverse)
    d = docs.withColumn("_d", F.from_json(F.col(text), SCHEMA, {"mode": "PERMISSIVE"}))
    matrix = F.col(f"_d.{key}")
    square = (F.size(matrix) == 3) & F.forall(matrix, lambda row: (F.size(row) == 3) & ~F.exists(row, lambda v: v.isNull()))
    checks = [F.when(F.try_parse_json(F.col(text)).isNull(), "no JSON"), F.when(matrix.isNull(), f"no {key}"), F.when(~F.coalesce(square, F.lit(False)), f"{key} is not 3 x 3")]
    values: dict[str, Column] = {f"m{i}{j}": F.get(F.get(matrix, F.lit(i)), F.lit(j)) for i in range(3) for j in range(3)}
    for side in ("fixed", "moving"):
        paths = F.col(f"_d.{side}_paths")
        shape, wrong = _one(paths, lambda p: p["image_shape"], f"image shapes of {side} images")
        size, other = _one(paths, lambda p: p["pixel_size_um"], f"pixel sizes of {side} images")
        checks += [wrong, other]
        values |= {f"{side}_height": F.get(shape, F.lit(0)), f"{side}_width": F.get(shape, F.lit(1)), f"{side}_um": size}
    problem = F.coalesce(*checks)
    if strict:
        problem = F.when(problem.isNotNull(), F.raise_error(problem).cast("string"))
    rest = [c for c in docs.columns if c != text]
    d = d.withColumn("problem", problem)
    return d.select(*rest, *(F.when(F.col("problem").isNull(), v).alias(k) for k, v in values.items()), "problem")


def read_registrations(spark: SparkSession, path: str, yx: bool = True, px: bool = True, inverse: bool = False) -> DataFrame:
    """The registrations stored at a path; a document that cannot be used is an error."""
    return registrations(documents(spark, path), yx, px, inverse, strict=True)
