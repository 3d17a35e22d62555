"""imzML: an index of where each pixel's spectrum lies in the binary file, and reads of what an ion image needs of it.

The index is a table (one row a pixel) made from the XML alone.  For ion images, tasks take pixels in the order of their bytes;
the m/z arrays are read in coalesced requests (of a file whose pixels share one array, that array once for a batch), the windows
are looked up in them, and of the intensities only the stretches in the windows are read.  Zlib arrays are read whole.
"""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slidespark.session import ship
from slidespark.storage import read_ranges

#: Accession numbers of the imaging and mass spectrometry vocabularies.
POSITION_X, POSITION_Y, TOTAL = "IMS:1000050", "IMS:1000051", "MS:1000285"
EXTERNAL_OFFSET, EXTERNAL_LENGTH, EXTERNAL_BYTES = "IMS:1000102", "IMS:1000103", "IMS:1000104"
MZ_ARRAY, INTENSITY_ARRAY, ZLIB = "MS:1000514", "MS:1000515", "MS:1000574"
TYPES = {"MS:1000521": "<f4", "MS:1000523": "<f8", "MS:1000519": "<i4", "MS:1000522": "<i8"}

ARRAY = ("at", "n", "bytes", "type", "packed")
INDEX = "y int, x int, total double, " + ", ".join(f"{k}_{c} {t}" for k in ("mz", "intensity") for c, t in zip(ARRAY, ("long", "long", "long", "string", "boolean"), strict=True))
PEAKS = "y int, x int, mz double, intensity double"
#: Bytes of the m/z arrays that one task reads, about.
TASK_BYTES = 64 << 20


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _params(e: ET.Element) -> dict[str, str | None]:
    return {c.get("accession"): c.get("value") for c in e if _local(c) == "cvParam"}


def index_rows(content: bytes) -> Iterator[tuple]:
    """Rows of INDEX, one for each spectrum of an imzML file."""
    groups: dict[str, dict] = {}
    for _, e in ET.iterparse(io.BytesIO(content)):
        if _local(e) == "referenceableParamGroup":
            groups[e.get("id")] = _params(e)
        elif _local(e) == "spectrum":
            own: dict = {}
            for c in e.iter():
                if _local(c) == "cvParam":
                    own.setdefault(c.get("accession"), c.get("value"))
            arrays = {}
            for a in e.iter():
                if _local(a) != "binaryDataArray":
                    continue
                held = dict(_params(a))
                for r in a:
                    if _local(r) == "referenceableParamGroupRef":
                        held |= groups.get(r.get("ref"), {})
                kind = "mz" if MZ_ARRAY in held else "intensity" if INTENSITY_ARRAY in held else None
                if kind and EXTERNAL_OFFSET in held:
                    dtype = next((t for k, t in TYPES.items() if k in held), "<f4")
                    n = int(held[EXTERNAL_LENGTH])
                    arrays[kind] = (int(held[EXTERNAL_OFFSET]), n, int(held.get(EXTERNAL_BYTES) or n * np.dtype(dtype).itemsize), dtype, ZLIB in held)
            none = (None,) * len(ARRAY)
            yield (int(own[POSITION_Y]), int(own[POSITION_X]), float(own.get(TOTAL) or "nan"), *arrays.get("mz", none), *arrays.get("intensity", none))
            e.clear()


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int32(), pa.int32(), pa.float64(), *[pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()] * 2]
    names = [f.split()[0] for f in INDEX.split(", ")]
    for b in batches:
        for content in b.column(0).to_pylist():
            rows = list(index_rows(content))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


def index(spark: SparkSession, path: str) -> DataFrame:
    """INDEX of an imzML file."""
    ship(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_index, INDEX)


def binary_of(path: str) -> str:
    """The binary file that goes with an imzML file."""
    return path[: -len("imzML")] + "ibd"


def _unpack(raw: bytes, dtype: str, packed: bool) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw) if packed else raw, dtype)


def _windows(mz: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of a rising array that lie in any of the windows, apart from each other."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(np.searchsorted(mz, low, "left").tolist(), np.searchsorted(mz, high, "right").tolist(), strict=True)):
        if a >= b:
            continue
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _peaks(path: str, low: Sequence[float], high: Sequence[float], with_bytes: bool):
    low_, high_ = np.array(low), np.array(high)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for r in b.to_pylist() if r["mz_at"] is not None and r["intensity_at"] is not None]
            # m/z arrays of this batch, each place once
            by_place: dict[tuple, list[dict]] = {}
            for r in rows:
                by_place.setdefault((r["mz_at"], r["mz_bytes"], r["mz_type"], r["mz_packed"]), []).append(r)
            places = list(by_place)
            read, todo, out = 0, [], []
            for k, raw in read_ranges(path, [(p[0], p[1]) for p in places]):
                read += len(raw)
                mz = _unpack(raw, places[k][2], places[k][3])
                found = [(0, len(mz))] if not len(low_) else _windows(mz, low_, high_)
                for r in by_place[places[k]]:
                    size = np.dtype(r["intensity_type"]).itemsize
                    if r["intensity_packed"]:
                        todo.append((r["intensity_at"], r["intensity_bytes"], r, [(a, z, mz[a:z]) for a, z in found]))
                    else:
                        todo += [(r["intensity_at"] + a * size, (z - a) * size, r, [(0, z - a, mz[a:z])]) for a, z in found]
            for k, raw in read_ranges(path, [t[:2] for t in todo]):
                read += len(raw)
                _, _, r, parts = todo[k]
                values = _unpack(raw, r["intensity_type"], r["intensity_packed"])
                out += [(r["y"], r["x"], mz, values[a:z]) for a, z, mz in parts]
            sizes = [len(o[2]) for o in out]
            columns = [pa.array(np.repeat([o[0] for o in out], sizes), pa.int32()), pa.array(np.repeat([o[1] for o in out], sizes), pa.int32())]
            columns += [pa.array(np.concatenate([np.asarray(o[k], np.float64) for o in out]) if out else [], pa.float64()) for k in (2, 3)]
            names = ["y", "x", "mz", "intensity"]
            if with_bytes:  # once for the batch, on a row of its own
                columns = [pa.concat_arrays([c, pa.nulls(1, c.type)]) for c in columns] + [pa.array([0] * len(columns[0]) + [read], pa.int64())]
                names = [*names, "bytes_read"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def peaks(spectra: DataFrame, binary: str, targets: Sequence[float] = (), ppm: float = 10.0, with_bytes: bool = False) -> DataFrame:
    """y, x, mz, intensity of the peaks of an index that are within ppm of a target (all, without targets).

    with_bytes: one more column, bytes_read, which is 0 but for one row of nulls from each batch that says what it has read.
    """
    spark = spectra.sparkSession
    ship(spark)
    half = [t * ppm * 1e-6 for t in targets]
    total = spectra.agg(F.sum("mz_bytes")).first()[0] or 0
    dealt = spectra.repartitionByRange(max(1, -(-total // TASK_BYTES)), "mz_at", "intensity_at").sortWithinPartitions("mz_at", "intensity_at")
    run = _peaks(binary, [t - h for t, h in zip(targets, half, strict=True)], [t + h for t, h in zip(targets, half, strict=True)], with_bytes)
    return dealt.mapInArrow(run, PEAKS + ", bytes_read long" * with_bytes)


def ion_images(spectra: DataFrame, binary: str, targets: Sequence[float], ppm: float = 10.0) -> DataFrame:
    """y, x, channel_id, value: the summed intensities around each target, a channel for each."""
    t = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(v)).alias("mz")) for k, v in enumerate(targets)))
    each = peaks(spectra, binary, targets, ppm).withColumn("t", F.explode(F.filter(t, lambda w: F.abs(w["mz"] - F.col("mz")) <= w["mz"] * F.lit(ppm * 1e-6))))
    return each.groupBy("y", "x", F.col("t.k").alias("channel_id")).agg(F.sum("intensity").alias("value"))


# m/z-ranged store of centroids


def write_centroids(table: DataFrame, path: str, files: int = 64) -> DataFrame:
    """Peaks (y, x, mz, intensity) as Parquet files of m/z ranges that do not overlap, and their bounds; returns the bounds.

    Equal m/z go to one file, unless AQE or a hot value splits it: bounds are those found in the files, so nothing is missed.
    """
    table.repartitionByRange(files, "mz").sortWithinPartitions("mz").write.parquet(f"{path}/peaks")
    held = table.sparkSession.read.parquet(f"{path}/peaks").withColumn("file", F.input_file_name())
    bounds = held.groupBy("file").agg(F.min("mz").alias("low"), F.max("mz").alias("high"), F.count(F.lit(1)).alias("n"))
    bounds.write.parquet(f"{path}/bounds")
    return table.sparkSession.read.parquet(f"{path}/bounds")


def centroid_files(spark: SparkSession, path: str, targets: Sequence[float], ppm: float = 10.0) -> list[str]:
    """The files of a store that can hold peaks within ppm of a target."""
    touched = F.lit(False)
    for t in targets:
        touched = touched | ((F.col("low") <= t * (1 + ppm * 1e-6)) & (F.col("high") >= t * (1 - ppm * 1e-6)))
    return sorted(r["file"] for r in spark.read.parquet(f"{path}/bounds").where(touched).collect())


def centroid_images(spark: SparkSession, path: str, targets: Sequence[float], ppm: float = 10.0) -> DataFrame:
    """y, x, channel_id, value: ion images from a store, of which only the files of the targets are opened."""
    found = centroid_files(spark, path, targets, ppm)
    schema = spark.read.parquet(f"{path}/peaks").schema
    table = spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)
    out = None
    for k, t in enumerate(targets):
        half = t * ppm * 1e-6
        part = table.where((F.col("mz") >= t - half) & (F.col("mz") <= t + half)).groupBy("y", "x").agg(F.sum("intensity").alias("value")).select("y", "x", F.lit(k).alias("channel_id"), "value")
        out = part if out is None else out.unionByName(part)
    return out


