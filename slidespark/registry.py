"""All queries by name, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slidespark.plans import document_queries, file_queries, geometry_queries  # noqa: F401  (they register queries)
from slidespark.plans.queries import ORACLE_SQL, QUERIES, crop_rescale_level

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crop_rescale_level(spark, sf_dir)
