"""GeoJSON, plain or zipped: every ring, line and point set becomes a shape of its own."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from slidespark.functions.scalars import UNNAMED
from slidespark.session import ship

VERTEX = "path string, shape_idx int, shape_name string, shape_type string, i int, x float, y float"


def load(content: bytes) -> list[dict]:
    """Features of a collection, a list or a single feature; of a zip file the last member counts."""
    if content[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            content = z.read(z.namelist()[-1])
    data = json.loads(content)
    if isinstance(data, dict):
        data = data["features"] if data.get("type") == "FeatureCollection" else [data]
    return data


def feature_name(feature: dict) -> str:
    props = feature.get("properties") or {}
    return (props.get("classification") or {}).get("name") or UNNAMED


def shapes_of(feature: dict) -> list[tuple[str, list]]:
    """Type and vertices of each shape in a feature; holes are shapes too."""
    geometry = feature["geometry"]
    kind, at = geometry["type"], geometry.get("coordinates")
    if kind == "Polygon":
        return [("polygon", ring) for ring in at]
    if kind == "MultiPolygon":
        return [("polygon", ring) for part in at for ring in part]
    if kind == "Point":
        return [("point", [at])]
    if kind == "MultiPoint":
        return [("points", at)]
    if kind == "LineString":
        return [("path", at)]
    raise ValueError(f"geometry {kind} is not supported")


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in VERTEX.split(", ")]
    types = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.float32(), pa.float32())
    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            rows, k = [], 0
            for feature in load(content):
                for kind, ring in shapes_of(feature):
                    rows += [(path, k, feature_name(feature), kind, i, float(v[0]), float(v[1])) for i, v in enumerate(ring)]
                    k += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], names)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Vertices (VERTEX) of all files at a path."""
    ship(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_parse, VERTEX)


def feature(vertices: list[tuple[float, float]], kind: str = "polygon", name: str = UNNAMED) -> dict:
    """A feature of vertices; polygon rings are closed."""
    at = [[float(x), float(y)] for x, y in vertices]
    if kind == "polygon":
        at = [at if at[0] == at[-1] else [*at, at[0]]]
    geometry = {"polygon": "Polygon", "points": "MultiPoint", "path": "LineString", "point": "Point"}[kind]
    return {"type": "Feature", "geometry": {"type": geometry, "coordinates": at[0] if kind == "point" else at}, "properties": {"classification": {"name": name}}}
