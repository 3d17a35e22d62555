"""NumPy files and PNG or JPEG images to pixels."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from slidespark.plans.levels import image_size
from slidespark.session import ship

PIXELS = "y int, x int, channel_id int, value double"


def pixel_batches(array: np.ndarray, top: int = 0, left: int = 0, axis: int | None = None, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """An image array (height, width), (channels, height, width) or (height, width, 3 or 4) as pixel rows, some lines at a time."""
    n, found, _ = image_size(array.shape)
    axis = found if axis is None else axis
    planes = array[None] if axis is None else np.moveaxis(array, axis, 0)
    for c in range(len(planes)):
        for y in range(0, planes.shape[1], rows):
            part = planes[c, y : y + rows]
            yy, xx = np.indices(part.shape, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array((yy + y + top).ravel().astype(np.int32)), pa.array((xx + left).ravel().astype(np.int32)), pa.array(np.full(part.size, c, np.int32)), pa.array(part.ravel().astype(np.float64))],
                ["y", "x", "channel_id", "value"],
            )


def load(content: bytes) -> tuple[np.ndarray, list[str]]:
    """The array of a .npy or .npz file, and its channel names (keys array or image, and labels or ppm_labels)."""
    data = np.load(io.BytesIO(content), allow_pickle=False)
    if isinstance(data, np.ndarray):
        return data, []
    array = next((data[k] for k in ("array", "image") if k in data), None)
    if array is None:
        raise ValueError("neither array nor image in the file")
    names = next((data[k] for k in ("labels", "ppm_labels") if k in data), [])
    return array, [str(n) for n in names]


def _pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for content in b.column(0).to_pylist():
            array, names = load(content)
            # an image with names has its channels last
            yield from pixel_batches(array, axis=2 if names and array.ndim == 3 else None)


def _header(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for content in b.column(0).to_pylist():
            array, names = load(content)
            n = array.shape[2] if names and array.ndim == 3 else image_size(array.shape)[0]
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([names], pa.list_(pa.string()))], ["n", "names"])


def read(spark: SparkSession, path: str) -> tuple[DataFrame, list[str], float]:
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    head = files.mapInArrow(_header, "n int, names array<string>").first()
    names = list(head["names"]) or [f"C{k}" for k in range(head["n"])]
    return files.mapInArrow(_pixels, PIXELS), names, 1.0


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of Spark's image source (height, width, channels, bytes as B, G, R, A) to pixels."""
    for b in batches:
        for h, w, n, data in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            array = np.frombuffer(data, np.uint8).reshape(h, w, n)
            yield from pixel_batches(array[:, :, [2, 1, 0, 3][:n]] if n >= 3 else array, axis=2)


def read_image(spark: SparkSession, path: str) -> tuple[DataFrame, list[str], float]:
    """PNG or JPEG through Spark's image source."""
    ship(spark)
    im = spark.read.format("image").load(path).select("image.*")
    n = im.select("nChannels").first()[0]
    return im.select("height", "width", "nChannels", "data").mapInArrow(_decoded, PIXELS), {1: ["grey"], 3: ["R", "G", "B"]}.get(n, ["R", "G", "B", "A"]), 1.0
