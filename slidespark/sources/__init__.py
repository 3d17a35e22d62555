"""Sources: a file or folder to tables, by its suffix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slidespark.plans.catalog import Catalog, Dataset, dataset_key

#: Suffixes by kind of source.
SUFFIXES = {
    "image": (".png", ".jpg", ".jpeg"),
    "tiff": (".ome.tiff", ".ome.tif", ".tiff", ".tif", ".svs", ".ndpi", ".qptiff", ".scn"),
    "zarr": (".ome.zarr", ".zarr"),
    "array": (".npy", ".npz"),
    "imzml": (".imzml",),
    "bruker": (".tsf", ".tdf", ".d"),
    "geojson": (".geojson", ".json", ".zip"),
    "table": (".csv", ".tsv", ".txt", ".parquet"),
    "closed": (".czi", ".h5", ".data"),
}


class UnsupportedFormatError(ValueError):
    """No reader for this file."""


def kind_of(path: str) -> str:
    low = path.lower().rstrip("/")
    for kind, ends in SUFFIXES.items():
        if low.endswith(ends):
            return kind
    raise UnsupportedFormatError(f"no reader for {path}")


def is_supported(path: str) -> bool:
    try:
        return kind_of(path) != "closed"
    except UnsupportedFormatError:
        return False


def read(spark: SparkSession, path: str, scene: int | None = None) -> Dataset:
    """The dataset at a path; pixels for images, vertices for shapes, x, y and features for points."""
    from . import arrays, geojson, spectra, tables, tiff, zarr

    kind = kind_of(path)
    if kind == "closed":
        raise UnsupportedFormatError(f"{path}: CZI and HDF5 need libraries that are not there; convert to Parquet (y, x, channel_id, value)")
    if kind == "geojson":
        return Dataset(dataset_key(path), path, geojson.read(spark, path), "shapes")
    if kind == "table":
        return tables.read(spark, path)
    reader = {"image": arrays.read_image, "tiff": tiff.read, "zarr": zarr.read, "array": arrays.read, "imzml": spectra.read_imzml, "bruker": spectra.read_bruker}[kind]
    frame, channels, resolution = reader(spark, path)
    return Dataset(dataset_key(path, scene), path, frame, "image", channels, resolution, scene=scene)


def read_into(spark: SparkSession, catalog: Catalog, *paths: str) -> list[str]:
    return [catalog.add(read(spark, p)) for p in paths]


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)
