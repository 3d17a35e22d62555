"""OME-Zarr folders that grow by channels.

Chunks are written by tasks into a folder of the append's own.  What makes them part of the image is one entry of a log
(`_commits/00000000.json` and on), which is created whole and only if no one else has created it; each entry holds the image as
it then is.  An append that dies before leaves the image as it was; one that dies after is complete, and whoever writes next
puts the chunks and the usual metadata (`.zarray` of every level, `.zattrs` last) where other readers look for them.  An
append carries an id: done twice, it counts once.  Appends at the same time get channels one after the other.

Files go through pyarrow's and Hadoop's file systems, so executors write wherever both can.
"""

from __future__ import annotations

import json
import os
import posixpath
import uuid
import zlib
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slidespark.operators.pixels import nearest_level
from slidespark.plans.levels import zarr_levels
from slidespark.session import ship
from slidespark.sources.codecs import blank, check_gaps
from slidespark.storage import locate

COMMITS, PARTS = "_commits", "_parts"


@dataclass
class State:
    """The image after an append; folders: where the chunks of each channel were written; gaps: missing pixels stay missing."""

    height: int
    width: int
    tile: int
    dtype: str
    resolution: float
    levels: int
    names: list[str] = field(default_factory=list)
    folders: list[str] = field(default_factory=list)
    appends: dict[str, list[int]] = field(default_factory=dict)
    gaps: bool = False

    def sizes(self) -> list[tuple[int, int]]:
        return [(max(1, self.height >> k), max(1, self.width >> k)) for k in range(self.levels)]


class CommitConflictError(RuntimeError):
    """Someone else has created the entry."""


def _entries(system: fs.FileSystem, root: str) -> list[str]:
    found = system.get_file_info(fs.FileSelector(posixpath.join(root, COMMITS), allow_not_found=True))
    return sorted(f.path for f in found if f.base_name.endswith(".json") and not f.base_name.startswith("."))


def latest(path: str) -> tuple[int, State | None]:
    """Number of the log's last entry, and what it says; -1 and None where there is no log."""
    system, root = locate(path)
    entries = _entries(system, root)
    if not entries:
        return -1, None
    with system.open_input_stream(entries[-1]) as f:
        return int(posixpath.basename(entries[-1])[:-5]), State(**json.loads(f.read()))


def _put(system: fs.FileSystem, path: str, data: bytes) -> None:
    """A file, whole or not at all."""
    system.create_dir(posixpath.dirname(path), recursive=True)
    if isinstance(system, fs.LocalFileSystem):
        beside = f"{posixpath.dirname(path)}/.{posixpath.basename(path)}.{uuid.uuid4().hex}"
        with system.open_output_stream(beside, compression=None) as f:
            f.write(data)
        system.move(beside, path)
    else:  # stores show an object once it is complete
        with system.open_output_stream(path, compression=None) as f:
            f.write(data)


def _write_chunks(folder: str, tile: int, dtype: str, gaps: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        level, c, ty, tx = (int(pdf[k].iloc[0]) for k in ("level", "channel_id", "ty", "tx"))
        cell = blank((tile, tile), dtype, gaps)
        cell[pdf["y"].to_numpy() - ty * tile, pdf["x"].to_numpy() - tx * tile] = pdf["value"].to_numpy()
        system, root = locate(folder)
        data = zlib.compress(cell.tobytes())
        _put(system, f"{root}/{level}/{c}/{ty}/{tx}", data)  # a task that runs again writes the same bytes
        return pd.DataFrame({"level": [level], "bytes": [len(data)]})

    return run


class ZarrStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.system, self.root = locate(self.path)

    @property
    def state(self) -> State | None:
        return latest(self.path)[1]

    def create(self, height: int, width: int, dtype: str = "<f4", tile: int = 256, resolution: float = 1.0, pyramid: bool = True, gaps: bool = False) -> State:
        """An image without channels; one that is there already stays.  Missing pixels are 0, or with gaps (floats only), missing."""
        check_gaps(dtype, gaps)
        held = self.state
        if held is not None:
            return held
        levels = len(zarr_levels(height, width, tile)) if pyramid else 1
        try:
            self._commit(0, State(height, width, tile, dtype, resolution, levels, gaps=gaps))
        except CommitConflictError:
            pass
        return self.state

    def append(self, px: DataFrame, names: Sequence[str], append_id: str | None = None) -> list[int]:
        """Add channels 0 .. len(names) - 1 of px behind those that are there; returns the numbers they get.

        append_id: a name for this append; if the log has it, nothing is done.
        """
        append_id = append_id or uuid.uuid4().hex
        held = self.state
        if held is None:
            raise ValueError(f"{self.path}: create the image first")
        if append_id in held.appends:
            self.publish()
            return held.appends[append_id]
        folder = f"{PARTS}/{uuid.uuid4().hex}"
        self._write(px, folder, held, len(names))
        while True:
            number, now = latest(self.path)
            if append_id in now.appends:  # someone did it meanwhile
                break
            first = len(now.names)
            now.names += names
            now.folders += [f"{folder}/{{level}}/{k}" for k in range(len(names))]
            now.appends[append_id] = list(range(first, first + len(names)))
            try:
                self._commit(number + 1, now)
                break
            except CommitConflictError:
                continue
        self.publish()
        return self.state.appends[append_id]

    def _write(self, px: DataFrame, folder: str, state: State, channels: int) -> None:
        ship(self.spark)
        every = None
        for k, (h, w) in enumerate(state.sizes()):
            level = (nearest_level(px, 2**k) if k else px).where((F.col("y") >= 0) & (F.col("y") < h) & (F.col("x") >= 0) & (F.col("x") < w)).withColumn("level", F.lit(k))
            every = level if every is None else every.unionByName(level)
        cells = every.where((F.col("channel_id") >= 0) & (F.col("channel_id") < channels))
        cells = cells.where("value IS NOT NULL") if state.gaps else cells.na.drop(subset=["value"])
        cells = cells.withColumns({"ty": F.floor(F.col("y") / state.tile).cast("int"), "tx": F.floor(F.col("x") / state.tile).cast("int")})
        done = cells.groupBy("level", "channel_id", "ty", "tx").applyInPandas(_write_chunks(f"{self.path}/{folder}", state.tile, state.dtype, state.gaps), "level int, bytes long")
        done.agg(F.sum("bytes")).collect()

    def _commit(self, number: int, state: State) -> None:
        """Create the entry, whole, unless it is there: a complete file gets its name by a step that does not replace."""
        beside, name = f"{COMMITS}/.{uuid.uuid4().hex}", f"{COMMITS}/{number:08d}.json"
        _put(self.system, f"{self.root}/{beside}", json.dumps(asdict(state)).encode())
        try:
            if isinstance(self.system, fs.LocalFileSystem):
                os.link(f"{self.root}/{beside}", f"{self.root}/{name}")
            else:
                self._rename(f"{self.path}/{beside}", f"{self.path}/{name}")
        except Exception as e:
            if isinstance(e, FileExistsError) or "AlreadyExists" in str(e):
                raise CommitConflictError(name) from e
            raise
        finally:
            if self.system.get_file_info(f"{self.root}/{beside}").type != fs.FileType.NotFound:
                self.system.delete_file(f"{self.root}/{beside}")

    def _rename(self, source: str, target: str) -> None:
        """Hadoop's rename without replacement, one step on a name node."""
        context, jvm = self.spark.sparkContext, self.spark.sparkContext._jvm
        hadoop, configuration = jvm.org.apache.hadoop.fs, self.spark.sparkContext._jsc.hadoopConfiguration()
        options = context._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        uri = hadoop.Path(source).getFileSystem(configuration).getUri()
        hadoop.FileContext.getFileContext(uri, configuration).rename(hadoop.Path(source), hadoop.Path(target), options)

    def publish(self) -> None:
        """Put the log's last image where other readers look; doing it again changes nothing."""
        held = self.state
        for level, (h, w) in enumerate(held.sizes()):
            for c, folder in enumerate(held.folders):
                source, target = f"{self.root}/{folder.format(level=level)}", f"{self.root}/{level}/{c}"
                if self.system.get_file_info(source).type == fs.FileType.Directory:
                    self.system.create_dir(posixpath.dirname(target), recursive=True)
                    self.system.move(source, target)
            meta = {"zarr_format": 2, "shape": [len(held.names), h, w], "chunks": [1, held.tile, held.tile], "dtype": held.dtype, "compressor": {"id": "zlib", "level": 6}, "fill_value": "NaN" if held.gaps else 0, "order": "C", "filters": None, "dimension_separator": "/"}
            _put(self.system, f"{self.root}/{level}/.zarray", json.dumps(meta).encode())
        axes = [{"name": "c", "type": "channel"}, *({"name": a, "type": "space", "unit": "micrometer"} for a in "yx")]
        sets = [{"path": str(k), "coordinateTransformations": [{"type": "scale", "scale": [1.0, held.resolution * held.height / h, held.resolution * held.width / w]}]} for k, (h, w) in enumerate(held.sizes())]
        attrs = {"multiscales": [{"version": "0.4", "axes": axes, "datasets": sets}], "omero": {"channels": [{"label": n} for n in held.names]}}
        _put(self.system, f"{self.root}/.zgroup", b'{"zarr_format": 2}')
        _put(self.system, f"{self.root}/.zattrs", json.dumps(attrs).encode())

    def vacuum(self) -> list[str]:
        """Remove what appends have left that never came to be; not while an append runs."""
        self.publish()
        used = {f.split("/")[1] for f in self.state.folders}
        gone = []
        for f in self.system.get_file_info(fs.FileSelector(f"{self.root}/{PARTS}", allow_not_found=True)):
            if f.base_name not in used or not any(x.type == fs.FileType.File for x in self.system.get_file_info(fs.FileSelector(f.path, recursive=True))):
                self.system.delete_dir(f.path)
                gone.append(f.base_name)
        return gone


def channel_folders(path: str, level: int) -> tuple[State | None, list[str]]:
    """The log's last image and the folder of each of its channels that has chunks, published or not."""
    system, root = locate(path)
    _, held = latest(path)
    out = []
    for c, folder in enumerate(held.folders if held else []):
        for place in (f"{level}/{c}", folder.format(level=level)):
            if system.get_file_info(f"{root}/{place}").type == fs.FileType.Directory:
                out.append((c, place))
                break
    return held, out


def write_zarr(px: DataFrame, path: str, height: int, width: int, names: Sequence[str], resolution: float = 1.0, tile: int = 256, dtype: str = "<f4", pyramid: bool = True, overwrite: bool = False) -> str:
    """An NGFF 0.4 folder of channel planes; levels take every second pixel of the one before.  An existing one is kept unless
    overwrite is set."""
    store = ZarrStore(px.sparkSession, path)
    held = store.state
    if (held is not None and held.names or store.system.get_file_info(f"{store.root}/.zattrs").type != fs.FileType.NotFound) and not overwrite:
        return path
    if overwrite and store.system.get_file_info(store.root).type == fs.FileType.Directory:
        store.system.delete_dir(store.root)
    store.create(height, width, dtype, tile, resolution, pyramid)
    store.append(px, list(names), "whole image")
    return path
