"""OME-Zarr folders (version 2; chunks raw, or in blosc with lz4, snappy, zlib or zstd, or in zlib, gzip, zstd or lz4), one task per group of chunk files."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slidespark.session import ship
from slidespark.sinks.zarr_store import channel_folders

from .arrays import PIXELS
from .codecs import GAPS, present, zarr_chunk


def attributes(text: str) -> dict:
    """The multiscale part of .zattrs: axes, dataset paths and scales, channel names."""
    data = json.loads(text)
    m = data["multiscales"][0]
    axes = [a["name"] if isinstance(a, dict) else a for a in m.get("axes", [])]
    sets = [d["path"] for d in m["datasets"]]
    scales = [next((t["scale"] for t in d.get("coordinateTransformations", []) if t.get("type") == "scale"), None) for d in m["datasets"]]
    names = [c.get("label", f"C{k}") for k, c in enumerate((data.get("omero") or {}).get("channels", []))]
    return {"axes": axes, "datasets": sets, "scales": scales, "names": names}


def dataset_order(names: list[str]) -> list[str]:
    """Numbers first, in order, then other names."""
    return sorted(names, key=lambda n: (not n.isdigit(), int(n) if n.isdigit() else 0, n))


def chunk_array(raw: bytes, meta: dict) -> np.ndarray:
    dtype = np.dtype(meta["dtype"])
    raw = zarr_chunk(raw, (meta.get("compressor") or {}).get("id"), int(np.prod(meta["chunks"])) * dtype.itemsize)
    return np.frombuffer(raw, dtype).reshape(meta["chunks"], order=meta.get("order", "C"))


def _chunks(meta: dict, axes: list[str], root: str, places: list[tuple[int, str]]):
    """Pixels of chunk files; places: folders of single channels, for images that have their channels in folders of their own."""
    spatial = {a: axes.index(a) for a in ("y", "x")}
    c_at = axes.index("c") if "c" in axes else None
    kind = np.dtype(meta["dtype"])
    gaps = meta.get("fill_value") == "NaN" and kind.kind == "f" and kind.itemsize in GAPS

    def index_of(path: str) -> list[int]:
        for c, folder in places:
            at = path.rfind(f"/{root}/{folder}/")
            if at >= 0:
                return [c, *map(int, path[at + len(root) + len(folder) + 3 :].split("/"))]
        return [int(v) for v in path[path.rindex(root) + len(root) :].strip("/").replace("/", ".").split(".")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at = index_of(path)
                array = chunk_array(raw, meta)
                start = [i * n for i, n in zip(at, meta["chunks"], strict=True)]
                array = array[tuple(slice(0, n - s) for n, s in zip(meta["shape"], start, strict=True))]
                index = np.indices(array.shape)
                col = {a: (index[k] + start[k]).ravel().astype(np.int32) for a, k in spatial.items()}
                channel = np.zeros(array.size, np.int32) if c_at is None else (index[c_at] + start[c_at]).ravel().astype(np.int32)
                held = present(array).ravel() if gaps else slice(None)
                yield pa.RecordBatch.from_arrays([pa.array(c[held]) for c in (col["y"], col["x"], channel, array.ravel().astype(np.float64))], ["y", "x", "channel_id", "value"])

    return run


def _text(spark: SparkSession, path: str) -> str:
    """A small metadata file; its name begins with a dot, so Spark's readers would skip it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(target)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def read(spark: SparkSession, path: str, level: int = 0) -> tuple[DataFrame, list[str], float]:
    """Pixels, channel names and resolution of a folder; of one that grows by channels, what its log says at this time."""
    ship(spark)
    path = path.rstrip("/")
    held, places = channel_folders(path, level)
    chunks = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if held is not None:
        h, w = held.sizes()[level]
        meta = {"shape": [len(held.names), h, w], "chunks": [1, held.tile, held.tile], "dtype": held.dtype, "compressor": {"id": "zlib"}, "order": "C", "fill_value": "NaN" if held.gaps else 0}
        resolution = held.resolution * (held.height / h + held.width / w) / 2
        if not places:
            return spark.createDataFrame([], PIXELS), held.names, resolution
        files = chunks.load([f"{path}/{folder}" for _, folder in places])
        return files.select("path", "content").mapInArrow(_chunks(meta, ["c", "y", "x"], path.rsplit("/", 1)[-1], places), PIXELS), held.names, resolution
    at = attributes(_text(spark, f"{path}/.zattrs"))
    name = at["datasets"][level]
    meta = json.loads(_text(spark, f"{path}/{name}/.zarray"))
    axes = at["axes"] or ["t", "c", "z", "y", "x"][-len(meta["shape"]) :]
    files = chunks.load(f"{path}/{name}").where(~F.col("path").rlike(r"/\.z\w+$"))
    root = f"{path.rsplit('/', 1)[-1]}/{name}"
    n = meta["shape"][axes.index("c")] if "c" in axes else 1
    names = at["names"] if len(at["names"]) == n else [f"C{k}" for k in range(n)]
    scale = at["scales"][level]
    resolution = (scale[axes.index("y")] + scale[axes.index("x")]) / 2 if scale else 1.0
    return files.select("path", "content").mapInArrow(_chunks(meta, axes, root, []), PIXELS), names, resolution
