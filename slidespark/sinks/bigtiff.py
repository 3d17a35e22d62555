"""OME-TIFF of any size, written by tasks: tiles are encoded where their pixels meet, and no tile passes through the driver.

1. Tasks encode tiles and stage them (Spark's commit protocol, so of several attempts at a task one counts), with the place of
   each tile within its part.
2. The lengths of the parts, one number for each task, are summed up to where each part begins in the file.
3. Tasks write their parts at those places of a file beside the target.  A task that runs again writes the same bytes to the
   same places.  The driver adds the directories, page by page, and names the first in the header.
4. The file is renamed to its target: readers see all of it or what was there before.

The target must be on a file system that the executors share and that can write at any place (a local or network disk).
Pixels that are missing are 0, or in an image of floats that has gaps, a NaN that is named as no data (tag 42113, as GDAL has
it) and is missing when it is read again.  A tile without pixels takes no room.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidespark.operators.pixels import block_mean
from slidespark.session import ship
from slidespark.sources.codecs import UnknownCodecError, blank, check_gaps
from slidespark.sources.tiff import NO_DATA
from slidespark.storage import drop, locate, staged

from .images import ome_xml

#: The numbers of compressions in TIFF's tag 259 by name.
METHODS = {"none": 1, "deflate": 8, "zstd": 50000}
ENCODED = "part int, level int, page int, ty int, tx int, at long, length long, data binary"
#: Bytes of the header of a BigTIFF file; tiles begin behind it.
HEADER = 16
#: Neighbouring tiles of a row that one task takes, so that they lie together in the file.
TOGETHER = 8


@dataclass
class Layout:
    """What the tiles of an image look like; samples: channels that share a tile (RGB)."""

    height: int
    width: int
    channels: int
    dtype: str
    tile: int
    samples: int = 1
    compression: str = "deflate"
    differences: bool = False
    gaps: bool = False

    def __post_init__(self) -> None:
        check_gaps(self.dtype, self.gaps)
        if self.tile % 16:
            raise ValueError("the side of a tile must be a multiple of 16")
        if self.compression not in METHODS:
            raise UnknownCodecError(f"no encoder for {self.compression}")
        if self.differences and np.dtype(self.dtype).kind == "f":
            raise ValueError("differences are for integers")

    @property
    def pages(self) -> int:
        return self.channels // self.samples

    def size(self, level: int) -> tuple[int, int]:
        return self.height >> level, self.width >> level

    def grid(self, level: int) -> tuple[int, int]:
        return tuple(-(-n // self.tile) for n in self.size(level))

    def encode(self, cells: np.ndarray) -> bytes:
        """A tile (tile, tile, samples) of the file's type."""
        if self.differences:
            cells = np.diff(cells, axis=1, prepend=np.zeros_like(cells[:, :1]))
        raw = np.ascontiguousarray(cells).astype(np.dtype(self.dtype).newbyteorder("<")).tobytes()
        if self.compression == "deflate":
            return zlib.compress(raw)
        return bytes(pa.Codec("zstd").compress(raw)) if self.compression == "zstd" else raw


def _encode(layout: Layout):
    """Rows sorted by tile to encoded tiles, and where each begins in this task's part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, now, cells = TaskContext.get().partitionId(), 0, None, None
        t, s = layout.tile, layout.samples

        def done() -> pa.RecordBatch:
            nonlocal at
            data = layout.encode(cells)
            row = [part, *now, at, len(data), data]
            at += len(data)
            kinds = [*[pa.int32()] * 5, pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [f.split()[0] for f in ENCODED.split(", ")])

        for b in batches:
            level, page, ty, tx, y, x, channel = (np.asarray(b.column(b.schema.get_field_index(c))) for c in ("level", "page", "ty", "tx", "y", "x", "channel_id"))
            value = np.asarray(b.column(b.schema.get_field_index("value"))).astype(layout.dtype)
            keys = np.stack([level, page, ty, tx], axis=1)
            starts = np.concatenate([[0], np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1, [len(keys)]]) if len(keys) else []
            for a, z in zip(starts, starts[1:], strict=False):
                key = tuple(keys[a].tolist())
                if key != now:
                    if now is not None:
                        yield done()
                    now, cells = key, blank((t, t, s), layout.dtype, layout.gaps)
                cells[y[a:z] - key[2] * t, x[a:z] - key[3] * t, channel[a:z] % s] = value[a:z]
        if now is not None:
            yield done()

    return run


def encode_tiles(px: DataFrame, layout: Layout, levels: int = 1) -> DataFrame:
    """The encoded tiles (ENCODED) of an image and of its levels, which are block means of the base; staged."""
    ship(px.sparkSession)
    every = None
    for k in range(levels):
        h, w = layout.size(k)
        level = block_mean(px, 2**k, layout.width, layout.height) if k else px
        level = level.where((F.col("y") >= 0) & (F.col("y") < h) & (F.col("x") >= 0) & (F.col("x") < w)).select("y", "x", "channel_id", "value", F.lit(k).alias("level"))
        every = level if every is None else every.unionByName(level)
    every = every.where((F.col("channel_id") >= 0) & (F.col("channel_id") < layout.channels))
    held = every.where("value IS NOT NULL") if layout.gaps else every.na.drop(subset=["value"])
    cells = held.withColumns({
        "page": F.floor(F.col("channel_id") / layout.samples).cast("int"), "ty": F.floor(F.col("y") / layout.tile).cast("int"), "tx": F.floor(F.col("x") / layout.tile).cast("int"),
    })
    dealt = cells.repartition("level", "page", "ty", F.floor(F.col("tx") / TOGETHER)).sortWithinPartitions("level", "page", "ty", "tx")
    return staged(dealt.mapInArrow(_encode(layout), ENCODED), "tiles")


def _place(path: str, base: dict[int, int]):
    """Write tiles at their places; returns how many bytes that were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, file = 0, os.open(path, os.O_WRONLY)
        try:
            for b in batches:
                for part, at, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    total += os.pwrite(file, data, base[part] + at)
        finally:
            os.close(file)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], ["bytes"])

    return run


def _directory(entries: Sequence[tuple[int, str, Sequence[int] | bytes]], at: int) -> bytes:
    """A BigTIFF directory for the file's place `at`, followed by what does not fit into it; its link to the next is 0."""
    rows, more = b"", b""
    behind = at + 8 + 20 * len(entries) + 8
    for tag, code, value in entries:
        raw = value if code == "s" else struct.pack(f"<{len(value)}{code}", *value)
        held = raw.ljust(8, b"\0")
        if len(raw) > 8:
            held = struct.pack("<Q", behind + len(more))
            more += raw + b"\0" * (-len(raw) % 8)
        rows += struct.pack("<HHQ", tag, {"s": 2, "H": 3, "I": 4, "Q": 16}[code], len(value)) + held
    return struct.pack("<Q", len(entries)) + rows + b"\0" * 8 + more


def _tags(layout: Layout, level: int, places: np.ndarray, lengths: np.ndarray, text: str, subs: Sequence[int]) -> list:
    h, w = layout.size(level)
    s, dtype = layout.samples, np.dtype(layout.dtype)
    return [
        (254, "I", [1 if level else 0]), (256, "I", [w]), (257, "I", [h]), (258, "H", [dtype.itemsize * 8] * s), (259, "H", [METHODS[layout.compression]]), (262, "H", [2 if s > 2 else 1]),
        *([(270, "s", text.encode() + b"\0")] if text else []), (277, "H", [s]), (284, "H", [1]), (317, "H", [2 if layout.differences else 1]), (322, "I", [layout.tile]), (323, "I", [layout.tile]),
        (324, "Q", places.tolist()), (325, "Q", lengths.tolist()), *([(330, "Q", list(subs))] if subs else []), (339, "H", [{"u": 1, "i": 2, "f": 3}[dtype.kind]] * s),
        *([(NO_DATA, "s", b"nan\0")] if layout.gaps else []),
    ]


def write_parts(tiles: DataFrame, path: str, layout: Layout, names: Sequence[str], resolution: float = 1.0, levels: int = 1) -> str:
    """The file of staged tiles (ENCODED).  Parts of several tables can be united, if their numbers of parts differ."""
    _, target = locate(path)
    lengths = {r["part"]: r["n"] for r in tiles.groupBy("part").agg(F.sum("length").alias("n")).collect()}  # a number for each task
    base, end = {}, HEADER
    for part in sorted(lengths):
        base[part], end = end, end + lengths[part]
    end += -end % 8
    beside = f"{target}.{uuid.uuid4().hex}.tmp"
    os.makedirs(os.path.dirname(os.path.abspath(target)), exist_ok=True)
    with open(beside, "wb") as f:
        f.truncate(end)
    try:
        tiles.select("part", "at", "data").mapInArrow(_place(beside, base), "bytes long").agg(F.sum("bytes")).collect()
        rows = tiles.select("page", "level", "ty", "tx", "part", "at", "length").orderBy("page", "level").toLocalIterator(prefetchPartitions=True)
        with open(beside, "r+b") as f:
            f.seek(end)
            last = 8  # where the place of the next main directory goes
            row = next(rows, None)
            for page in range(layout.pages):
                found = []  # the directories of this page: one page at a time is held
                for level in range(levels):
                    down, across = layout.grid(level)
                    places, sizes = np.zeros(down * across, np.int64), np.zeros(down * across, np.int64)
                    while row is not None and (row["page"], row["level"]) == (page, level):
                        k = row["ty"] * across + row["tx"]
                        places[k], sizes[k] = base[row["part"]] + row["at"], row["length"]
                        row = next(rows, None)
                    found.append((places, sizes))
                subs = []
                for level in range(1, levels):
                    subs.append(f.tell())
                    f.write(_directory(_tags(layout, level, *found[level], "", ()), f.tell()))
                at = f.tell()
                text = ome_xml(layout.width, layout.height, names, layout.dtype, resolution, layout.samples > 1) if not page else ""
                entries = _tags(layout, 0, *found[0], text, subs)
                f.write(_directory(entries, at))
                here = f.tell()
                f.seek(last)
                f.write(struct.pack("<Q", at))
                last = at + 8 + 20 * len(entries)
                f.seek(here)
            first = f.seek(8) and f.read(8)
            f.seek(0)
            f.write(b"II" + struct.pack("<HHH", 43, 8, 0) + first)
            f.flush()
            os.fsync(f.fileno())
        os.replace(beside, target)
    except BaseException:
        os.unlink(beside)
        raise
    return path


def write_ome_tiff(
    px: DataFrame, path: str, height: int, width: int, names: Sequence[str], resolution: float = 1.0, tile: int = 256, levels: int = 1,
    dtype: str = "float32", rgb: bool = False, compression: str = "deflate", differences: bool = False, overwrite: bool = False, gaps: bool = False,
) -> str:
    """A pyramidal OME-TIFF (BigTIFF) of pixels; an existing file is kept unless overwrite is set.  With gaps, pixels that are
    missing stay missing (floats only)."""
    if os.path.exists(locate(path)[1]) and not overwrite:
        return path
    layout = Layout(height, width, len(names), np.dtype(dtype).name, tile, len(names) if rgb else 1, compression, differences, gaps)
    tiles = encode_tiles(px, layout, levels)
    write_parts(tiles, path, layout, names, resolution, levels)
    drop(tiles)
    return path


class ChannelWriter:
    """An OME-TIFF that grows by channels: each is encoded when it is added, the file is written at the end.

    Channels can come from different tables and at different times; what is added is staged in the shared folder.
    """

    def __init__(self, height: int, width: int, dtype: str = "float32", tile: int = 256, levels: int = 1, compression: str = "deflate") -> None:
        self.height, self.width, self.dtype, self.tile, self.levels, self.compression = height, width, np.dtype(dtype).name, tile, levels, compression
        self.names: list[str] = []
        self.parts: list[DataFrame] = []

    def _layout(self, channels: int) -> Layout:
        return Layout(self.height, self.width, channels, self.dtype, self.tile, 1, self.compression)

    def add(self, plane: DataFrame, name: str) -> int:
        """Add a plane (y, x, value) as the next channel; returns its number."""
        if name in self.names:
            raise ValueError(f"there is a channel {name} already")
        page = len(self.names)
        tiles = encode_tiles(plane.select("y", "x", F.lit(0).alias("channel_id"), "value"), self._layout(1), self.levels)
        self.names.append(name)
        self.parts.append(tiles.withColumn("page", F.lit(page)))
        return page

    def write(self, path: str, resolution: float = 1.0, overwrite: bool = False) -> str:
        """Write all channels that were added so far; more can be added and written later."""
        if os.path.exists(locate(path)[1]) and not overwrite:
            return path
        every, shift = None, 0
        for tiles in self.parts:
            # parts of different tables get numbers of their own
            most = tiles.agg(F.max("part")).first()[0]
            moved = tiles.withColumn("part", F.col("part") + shift)
            shift += 1 + (most or 0)
            every = moved if every is None else every.unionByName(moved)
        if every is None:
            raise ValueError("no channel was added")
        return write_parts(every, path, self._layout(len(self.names)), self.names, resolution, self.levels)
