"""PNG, and OME-TIFF of an array that the driver holds; images of any size are written by bigtiff and zarr_store."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Sequence
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame



def to_array(px: DataFrame, height: int, width: int, channels: int, fill: float = np.nan) -> np.ndarray:
    """A small image as (channels, height, width) on the driver."""
    out = np.full((channels, height, width), fill)
    for r in px.select("channel_id", "y", "x", "value").toLocalIterator(prefetchPartitions=True):
        out[r["channel_id"], r["y"], r["x"]] = fill if r["value"] is None else r["value"]
    return out


def png(array: np.ndarray) -> bytes:
    """8-bit grey (height, width) or RGB(A) (height, width, 3 or 4)."""
    h, w = array.shape[:2]
    kind = {1: 0, 3: 2, 4: 6}[1 if array.ndim == 2 else array.shape[2]]
    raw = b"".join(b"\0" + row.tobytes() for row in np.ascontiguousarray(array, np.uint8))

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def ome_xml(width: int, height: int, names: Sequence[str], dtype: str, resolution: float, rgb: bool = False) -> str:
    from xml.sax.saxutils import quoteattr

    kind = {"float32": "float", "float64": "double"}.get(dtype, dtype)
    listed = [("RGB", len(names))] if rgb else [(n, 1) for n in names]
    channels = "".join(f'<Channel ID="Channel:0:{k}" Name={quoteattr(n)} SamplesPerPixel="{s}"/>' for k, (n, s) in enumerate(listed))
    return (
        '<?xml version="1.0" encoding="UTF-8"?><OME xmlns="http://www.openmicroscopy.org/Schemas/OME/2016-06"><Image ID="Image:0">'
        f'<Pixels ID="Pixels:0" DimensionOrder="XYCZT" Type="{kind}" SizeX="{width}" SizeY="{height}" SizeC="{len(names)}" SizeZ="1" SizeT="1" '
        f'PhysicalSizeX="{resolution}" PhysicalSizeY="{resolution}" PhysicalSizeXUnit="um" PhysicalSizeYUnit="um">{channels}<TiffData/></Pixels></Image></OME>'
    )


class TiffFile:
    """A growing classic TIFF in memory: deflated tiles, levels as sub-images."""

    def __init__(self) -> None:
        self.data = bytearray(b"II*\0\0\0\0\0")
        self.last = 4

    def _put(self, raw: bytes) -> int:
        if len(self.data) % 2:
            self.data += b"\0"
        self.data += raw
        return len(self.data) - len(raw)

    def _page(self, array: np.ndarray, tile: int, text: str, subs: Sequence[int], reduced: bool) -> int:
        h, w = array.shape[:2]
        s = 1 if array.ndim == 2 else array.shape[2]
        cells = []
        for y in range(0, h, tile):
            for x in range(0, w, tile):
                part = np.zeros((tile, tile, s), array.dtype)
                own = array[y : y + tile, x : x + tile].reshape(min(tile, h - y), min(tile, w - x), s)
                part[: own.shape[0], : own.shape[1]] = own
                raw = zlib.compress(part.astype(part.dtype.newbyteorder("<")).tobytes())
                cells.append((self._put(raw), len(raw)))
        kind = {"u": 1, "i": 2, "f": 3}[array.dtype.kind]
        tags: list[tuple[int, str, Sequence[int] | bytes]] = [
            (254, "I", [1 if reduced else 0]), (256, "I", [w]), (257, "I", [h]), (258, "H", [array.dtype.itemsize * 8] * s), (259, "H", [8]), (262, "H", [2 if s > 2 else 1]),
            *([(270, "s", text.encode() + b"\0")] if text else []), (277, "H", [s]), (284, "H", [1]), (322, "I", [tile]), (323, "I", [tile]), (324, "I", [c[0] for c in cells]), (325, "I", [c[1] for c in cells]),
            *([(330, "I", list(subs))] if subs else []), (339, "H", [kind] * s),
        ]
        rows = b""
        for tag, code, v in tags:
            raw = v if code == "s" else struct.pack(f"<{len(v)}{code}", *v)
            held = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", self._put(raw))
            rows += struct.pack("<HHI", tag, {"s": 2, "H": 3, "I": 4}[code], len(v)) + held
        return self._put(struct.pack("<H", len(tags)) + rows + b"\0\0\0\0")

    def add(self, levels: Sequence[np.ndarray], tile: int, text: str = "") -> None:
        subs = [self._page(a, tile, "", (), True) for a in levels[1:]]
        at = self._page(levels[0], tile, text, subs, False)
        struct.pack_into("<I", self.data, self.last, at)
        (n,) = struct.unpack_from("<H", self.data, at)
        self.last = at + 2 + 12 * n


def halves(array: np.ndarray, sizes: Sequence[tuple[int, int]]) -> list[np.ndarray]:
    """Levels of an image by block means of the base."""
    out = [array]
    for k in range(1, len(sizes)):
        f = 2**k
        h, w = array.shape[0] // f, array.shape[1] // f
        out.append(array[: h * f, : w * f].reshape(h, f, w, f, *array.shape[2:]).mean((1, 3)).astype(array.dtype))
    return out


def write_tiff(array: np.ndarray, path: str, names: Sequence[str], resolution: float = 1.0, tile: int = 256, levels: int = 1, rgb: bool = False, overwrite: bool = False) -> str:
    """A pyramidal OME-TIFF of (channels, height, width); written beside its name, then renamed."""
    if os.path.exists(path) and not overwrite:
        return path
    f = TiffFile()
    sizes = [(array.shape[1] // 2**k, array.shape[2] // 2**k) for k in range(levels)]
    text = ome_xml(array.shape[2], array.shape[1], names, str(array.dtype), resolution, rgb)
    for k, plane in enumerate([np.moveaxis(array, 0, 2)] if rgb else array):
        f.add(halves(plane, sizes), tile, text if not k else "")
    Path(path + ".tmp").write_bytes(bytes(f.data))
    os.replace(path + ".tmp", path)
    return path
