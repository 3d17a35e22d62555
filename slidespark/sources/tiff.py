"""TIFF (classic or Big, tiles or strips; stored, deflate, LZW, PackBits or zstd; levels as sub-images or further pages).

A file is a Spark data source of pixels.  The driver reads the header only; boxes and channels that a query filters by are
pushed into it, so only the tiles that they touch are planned, in runs of neighbouring byte ranges, and only those are read and
decoded, each run by one task.  JPEG and JPEG 2000 tiles are a typed error.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from slidespark.functions.scalars import LENGTH_UNITS, TIFF_UNITS
from slidespark.session import ship
from slidespark.storage import Blocks, read_ranges, runs

from .arrays import PIXELS
from .codecs import GAPS, blank, present, tiff_tile, undo_differences

#: Bytes and struct codes of TIFF field types.
FIELD = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 13: (4, "I"), 16: (8, "Q"), 17: (8, "q"), 18: (8, "Q")}
#: Fixed value: the tag that names what stands for missing pixels.
NO_DATA = 42113
#: Pixels that a task decodes, about.
TASK_PIXELS = 1 << 22
#: Beyond the sides of any image.
FAR = 1 << 40
#: How far the sides of a level may be from those of the base, divided by one number.
LEVEL_TOLERANCE = 0.02


@dataclass
class Page:
    tags: dict[int, tuple | bytes]
    order: str

    def one(self, tag: int, default=None):
        v = self.tags.get(tag)
        return default if v is None else v[0]

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.one(257), self.one(256), self.one(277, 1)

    @property
    def dtype(self) -> np.dtype:
        kind = {1: "u", 2: "i", 3: "f"}[self.one(339, 1)]
        return np.dtype(f"{self.order}{kind}{self.one(258, 8) // 8}")

    @property
    def resolution(self) -> float:
        """Micrometres per pixel; 1.0 where the tags tell none."""
        v = self.tags.get(282)
        return 1.0 if not v or not v[0] else v[1] / v[0] * TIFF_UNITS.get(self.one(296, 2), 1.0) if self.one(296, 2) != 1 else 1.0

    @property
    def tiled(self) -> bool:
        return 322 in self.tags

    def cells(self) -> tuple[int, int]:
        """Height and width of a tile or strip."""
        h, w, _ = self.shape
        return (self.one(323), self.one(322)) if self.tiled else (min(self.one(278, h), h), w)


def _number(data: bytes, code: str) -> int:
    return struct.unpack(code, data)[0]


class TiffHeader:
    """The pages of a file and their levels; data is anything with read(at, n)."""

    def __init__(self, data: Blocks) -> None:
        self.data = data
        self.order = "<" if data.read(0, 2) == b"II" else ">"
        version = _number(data.read(2, 2), self.order + "H")
        if version not in (42, 43):
            raise ValueError("not a TIFF file")
        self.big = version == 43
        self.word, self.step = (8, 20) if self.big else (4, 12)
        self.pages: list[Page] = []
        at = self._word(8 if self.big else 4)
        while at:
            page, at = self._directory(at)
            self.pages.append(page)

    def _word(self, at: int) -> int:
        return _number(self.data.read(at, self.word), self.order + ("Q" if self.big else "I"))

    def _directory(self, at: int) -> tuple[Page, int]:
        wide = 8 if self.big else 2
        count = _number(self.data.read(at, wide), self.order + ("Q" if self.big else "H"))
        rows, tags = self.data.read(at + wide, count * self.step), {}
        for k in range(count):
            tag, kind, n = struct.unpack_from(self.order + ("HHQ" if self.big else "HHI"), rows, k * self.step)
            if kind not in FIELD:
                continue
            size, code = FIELD[kind]
            held = rows[(k + 1) * self.step - self.word : (k + 1) * self.step]
            if size * n > self.word:
                held = self.data.read(_number(held, self.order + ("Q" if self.big else "I")), size * n)
            tags[tag] = held[:n].rstrip(b"\0") if code == "s" else struct.unpack_from(f"{self.order}{n * len(code)}{code[0]}", held)
        return Page(tags, self.order), self._word(at + wide + count * self.step)

    def levels(self) -> list[list[Page]]:
        """The pages of each level, the largest first: those of the size of the largest page, and what are its smaller copies."""
        by_shape: dict[tuple[int, ...], list[Page]] = {}
        for p in self.pages:
            by_shape.setdefault(p.shape, []).append(p)
        base = max(by_shape.values(), key=lambda own: own[0].shape[0] * own[0].shape[1])
        subs = [[self._directory(at)[0] for at in p.tags.get(330, ())] for p in base]
        if any(subs):
            return [base, *(list(level) for level in zip(*subs, strict=True))]
        h, w, s = base[0].shape
        small = []
        for shape, own in by_shape.items():
            ratio = h / shape[0], w / shape[1]
            like = abs(ratio[0] / ratio[1] - 1) <= LEVEL_TOLERANCE and shape[2] == s and len(own) == len(base) and own[0].tiled == base[0].tiled
            if own is not base and like:
                small.append(own)
        return [base, *sorted(small, key=lambda own: -own[0].shape[0] * own[0].shape[1])]


@dataclass
class Tile:
    """Where a tile lies in the file and in the image; channels: numbers of its samples."""

    offset: int
    length: int
    y: int
    x: int
    height: int
    width: int
    rows: int
    channels: tuple[int, ...]


@dataclass
class Box:
    """The pixels that a query can want, by what it filters: half-open ranges, and channels (None: all)."""

    y: list[int] = field(default_factory=lambda: [0, FAR])
    x: list[int] = field(default_factory=lambda: [0, FAR])
    channels: frozenset | None = None

    def narrow(self, f: Filter) -> None:
        """Take a filter into account, if it is one of a column and constants."""
        column = getattr(f, "attribute", None)
        if column == ("channel_id",) and isinstance(f, (EqualTo, In)):
            wanted = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
            self.channels = wanted if self.channels is None else self.channels & wanted
        elif column in (("y",), ("x",)):
            side = getattr(self, column[0])
            if isinstance(f, (EqualTo, GreaterThanOrEqual, GreaterThan)):
                side[0] = max(side[0], f.value + isinstance(f, GreaterThan))
            if isinstance(f, (EqualTo, LessThanOrEqual, LessThan)):
                side[1] = min(side[1], f.value + (not isinstance(f, LessThan)))

    def wants(self, t: Tile) -> bool:
        return t.y < self.y[1] and t.y + t.height > self.y[0] and t.x < self.x[1] and t.x + t.width > self.x[0] and (self.channels is None or not self.channels.isdisjoint(t.channels))


def tiles(page: Page, first: int, box: Box) -> Iterator[Tile]:
    """The tiles or strips of a page that the box touches; its channels are numbered from first."""
    h, w, s = page.shape
    th, tw = page.cells()
    offsets, lengths = page.tags[324 if page.tiled else 273], page.tags[325 if page.tiled else 279]
    planes = s if page.one(284, 1) == 2 and s > 1 else 1
    across, down = -(-w // tw), -(-h // th)
    rows = range(max(box.y[0] // th, 0), min(-(-box.y[1] // th), down))
    columns = range(max(box.x[0] // tw, 0), min(-(-box.x[1] // tw), across))
    for plane in range(planes):
        channels = (first + plane,) if planes > 1 else tuple(range(first, first + s))
        for j in rows:
            for i in columns:
                k = (plane * down + j) * across + i
                tile = Tile(offsets[k], lengths[k], j * th, i * tw, min(th, h - j * th), min(tw, w - i * tw), th if page.tiled else min(th, h - j * th), channels)
                if box.wants(tile):
                    yield tile


@dataclass
class Coding:
    """What decodes the tiles of a level."""

    dtype: str
    method: int
    predictor: int
    width: int
    gaps: bool = False

    @classmethod
    def of(cls, page: Page) -> Coding:
        return cls(page.dtype.str, page.one(259, 1), page.one(317, 1), page.cells()[1], page.dtype.kind == "f" and page.dtype.itemsize in GAPS and page.tags.get(NO_DATA) == b"nan")

    def array(self, raw: bytes, tile: Tile) -> np.ndarray:
        """(channels, height, width); a tile of no bytes is empty."""
        dtype, n = np.dtype(self.dtype), tile.rows * self.width * len(tile.channels)
        if not tile.length:
            return blank((len(tile.channels), tile.height, tile.width), dtype, self.gaps)
        part = np.frombuffer(tiff_tile(raw, self.method, n * dtype.itemsize), dtype, n).reshape(tile.rows, self.width, -1)
        if self.predictor != 3:
            part = part.astype(dtype.newbyteorder("="))
        return np.moveaxis(undo_differences(part, self.predictor), 2, 0)[:, : tile.height, : tile.width]


@dataclass
class Run(InputPartition):
    """Tiles that one task reads."""

    tiles: list[Tile]
    coding: Coding


class TiffReader(DataSourceReader):
    def __init__(self, path: str, level: int, with_tiles: bool) -> None:
        self.path, self.level, self.with_tiles, self.box = path, level, with_tiles, Box()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            self.box.narrow(f)
        return filters  # Spark filters the rows of the tiles that are read

    def partitions(self) -> Sequence[InputPartition]:
        data = Blocks(self.path)
        pages = TiffHeader(data).levels()[self.level]
        data.close()
        out, first = [], 0
        for page in pages:
            found, coding = list(tiles(page, first, self.box)), Coding.of(page)
            pixels = max(1, coding.width * page.cells()[0])
            for run in runs([(t.offset, t.length) for t in found]):
                # a run of the file is one request; long ones are dealt to several tasks
                most = max(1, TASK_PIXELS // pixels)
                out += [Run([found[k] for k in run[i : i + most]], coding) for i in range(0, len(run), most)]
            first += page.shape[2]
        return _joined(out)

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing was planned
            return
        todo = partition.tiles
        for k, raw in read_ranges(self.path, [(t.offset, t.length) for t in todo]):
            yield from self._rows(partition.coding.array(raw, todo[k]), todo[k], partition.coding.gaps)

    def _rows(self, array: np.ndarray, tile: Tile, gaps: bool) -> Iterator[pa.RecordBatch]:
        top, left = (max(0, side[0] - start) for side, start in ((self.box.y, tile.y), (self.box.x, tile.x)))
        below, right = (min(n, side[1] - start) for side, start, n in ((self.box.y, tile.y, tile.height), (self.box.x, tile.x, tile.width)))
        for k, channel in enumerate(tile.channels):
            if self.box.channels is not None and channel not in self.box.channels:
                continue
            part = array[k, top:below, left:right]
            if not part.size:
                continue
            y, x = np.indices(part.shape, dtype=np.int32)
            columns = {"y": y + np.int32(tile.y + top), "x": x + np.int32(tile.x + left), "channel_id": np.full(part.shape, channel, np.int32), "value": part.astype(np.float64)}
            if self.with_tiles:
                columns |= {"tile": np.full(part.shape, tile.offset, np.int64), "tile_bytes": np.full(part.shape, tile.length, np.int64)}
            held = present(part) if gaps else slice(None)
            yield pa.RecordBatch.from_arrays([pa.array(c[held].ravel()) for c in columns.values()], list(columns))


def _joined(parts: list[Run]) -> list[Run]:
    """Short runs together, so that a task has enough to do."""
    out: list[Run] = []
    for p in parts:
        most = max(1, TASK_PIXELS // max(1, p.coding.width * p.tiles[0].rows))
        if out and out[-1].coding == p.coding and len(out[-1].tiles) + len(p.tiles) <= most:
            out[-1].tiles += p.tiles
        else:
            out.append(p)
    return out


class TiffSource(DataSource):
    """Options: path; level (0); tiles (true: two more columns, the offset and length in the file of the tile of each pixel)."""

    @classmethod
    def name(cls) -> str:
        return "slide_tiff"

    def schema(self) -> str:
        return PIXELS + ", tile long, tile_bytes long" * (self.options.get("tiles") == "true")

    def reader(self, schema) -> TiffReader:
        return TiffReader(self.options["path"], int(self.options.get("level", 0)), self.options.get("tiles") == "true")


def channel_names(description: str, n: int, rgb: bool) -> list[str]:
    """Names of an OME description, else R, G, B or C01 and on."""
    found = re.findall(r"<Channel\b[^>]*\bName=\"([^\"]*)\"", description)
    if len(found) == n:
        return found
    return ["R", "G", "B", "A"][:n] if rgb else [f"C{k + 1:02d}" for k in range(n)]


def resolution(description: str, page: Page, svs: bool = False) -> float:
    if svs and (m := re.search(r"MPP[^|=]*=\s*([0-9.eE+-]+)", description)):
        return float(m[1])
    if m := re.search(r"PhysicalSizeX=\"([^\"]+)\"", description):
        unit = re.search(r"PhysicalSizeXUnit=\"([^\"]+)\"", description)
        return float(m[1]) * LENGTH_UNITS.get(unit[1] if unit else "um", 1.0)
    return page.resolution


def read(spark: SparkSession, path: str, level: int = 0, tiles: bool = False) -> tuple[DataFrame, list[str], float]:
    """Pixels, channel names and resolution of a file.  Filters by y, x and channel_id choose the tiles that are read."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TiffSource)
    data = Blocks(path)
    found = TiffHeader(data).levels()
    data.close()
    text = (found[0][0].tags.get(270) or b"").decode("utf-8", "replace")
    n = sum(p.shape[2] for p in found[0])
    names = channel_names(text, n, len(found[0]) == 1 and n in (3, 4))
    scale = found[0][0].shape[0] / found[level][0].shape[0]
    px = spark.read.format("slide_tiff").option("path", path).option("level", level).option("tiles", str(tiles).lower()).load()
    return px, names, resolution(text, found[0][0]) * scale
