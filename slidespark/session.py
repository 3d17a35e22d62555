"""Session options, and shipping of this package to Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Options that the plans of this package are written for; a cluster's own settings win over them.
OPTIONS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

_shipped: set[str] = set()


def session(app: str = "slidespark", **options: str) -> SparkSession:
    """The running session, or a new one with OPTIONS and the given options (dots written as double underscores)."""
    builder = SparkSession.builder.appName(app)
    for k, v in {**OPTIONS, **{k.replace("__", "."): v for k, v in options.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for an application: they need no installed copy."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="slidespark-"), "slidespark.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"slidespark/{f.relative_to(root)}")
    sc.addPyFile(path)
