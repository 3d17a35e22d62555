"""Decoders of compressed tiles and chunks: what TIFF and zarr files hold, with pyarrow's libraries underneath where there are any."""

from __future__ import annotations

import gzip
import struct
import zlib

import numpy as np
import pyarrow as pa


class UnknownCodecError(ValueError):
    """A compression that no decoder here knows."""


#: Bits of the NaN that stands for a missing pixel, by the bytes of a number: other readers see NaN, and no value has these bits.
GAPS = {2: 0x7E2A, 4: 0x7FC02A2A, 8: 0x7FF8000000002A2A}


def blank(shape: tuple[int, ...], dtype: str | np.dtype, gaps: bool) -> np.ndarray:
    """Cells without pixels: zeros, or with gaps, missing ones."""
    kind = np.dtype(dtype)
    return np.full(shape, GAPS[kind.itemsize], np.dtype(f"u{kind.itemsize}").newbyteorder(kind.byteorder)).view(kind) if gaps else np.zeros(shape, kind)


def present(cells: np.ndarray) -> np.ndarray:
    """Which cells are not missing, in an array that has gaps."""
    kind = cells.dtype
    return cells.view(np.dtype(f"u{kind.itemsize}").newbyteorder(kind.byteorder)) != GAPS[kind.itemsize]


def check_gaps(dtype: str, gaps: bool) -> None:
    kind = np.dtype(dtype)
    if gaps and (kind.kind != "f" or kind.itemsize not in GAPS):
        raise ValueError(f"missing pixels cannot be told from others in {dtype}")


def packbits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2 if n > 128 else 1
    return bytes(out)


#: Fixed values of TIFF's LZW: the codes that empty the table and end the data, and the widths of codes.
LZW_CLEAR, LZW_END, LZW_FIRST, LZW_WIDTHS = 256, 257, 258, (9, 12)


def lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes from the high bit on, one bit wider as soon as the table's next entry but one needs it."""
    least, most = LZW_WIDTHS
    single = [bytes([k]) for k in range(256)] + [b"", b""]
    table, width, before = list(single), least, None
    out, bits, held, at = [], 0, 0, 0
    while True:
        while held < width:
            if at == len(data):
                return b"".join(out)
            bits, held, at = (bits & (1 << held) - 1) << 8 | data[at], held + 8, at + 1
        held -= width
        code = bits >> held & (1 << width) - 1
        if code == LZW_END:
            return b"".join(out)
        if code == LZW_CLEAR:
            table, width, before = list(single), least, None
            continue
        if before is None:
            entry = table[code]
        else:
            # the code that is just being made is what came before and its own first byte
            entry = table[code] if code < len(table) else before + before[:1]
            table.append(before + entry[:1])
            if len(table) + 1 >= 1 << width and width < most:
                width += 1
        out.append(entry)
        before = entry


def undo_differences(part: np.ndarray, predictor: int) -> np.ndarray:
    """Rows (rows, columns, samples) of a tile with TIFF's horizontal differences (2) or floating-point bytes (3) summed up."""
    if predictor in (None, 1):
        return part
    if predictor == 2:
        return np.cumsum(part, axis=1, dtype=part.dtype)
    if predictor == 3:
        rows, columns, samples = part.shape
        size = part.dtype.itemsize
        # each row: differences of bytes, `samples` apart; the high bytes of all values first
        planes = np.frombuffer(part.tobytes(), np.uint8).reshape(rows, -1, samples)
        planes = np.cumsum(planes, axis=1, dtype=np.uint8).reshape(rows, size, columns * samples)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">f{size}").reshape(rows, columns, samples).astype(f"=f{size}")
    raise UnknownCodecError(f"TIFF predictor {predictor}")


def tiff_tile(data: bytes, method: int, size: int) -> bytes:
    """The bytes of a tile or strip by the number of TIFF's compression tag; size: how many there are at most."""
    if method == 1:
        return data
    if method == 5:
        return lzw(data)
    if method in (8, 32946):
        return zlib.decompress(data)
    if method == 32773:
        return packbits(data)
    if method == 50000:
        return bytes(pa.Codec("zstd").decompress(data, size))
    raise UnknownCodecError(f"TIFF compression {method}")


#: Fixed values of the blosc container: flag bits, the number of the compressor in the flags, bytes of the header.
BLOSC_SHUFFLE, BLOSC_STORED, BLOSC_BITS, BLOSC_WHOLE, BLOSC_HEADER = 1, 2, 4, 16, 16
BLOSC_LIBRARIES = {1: "lz4_raw", 2: "snappy", 3: "zlib", 4: "zstd"}


def _unpack(data: bytes, library: str, size: int) -> bytes:
    return zlib.decompress(data) if library == "zlib" else bytes(pa.Codec(library).decompress(data, size))


def _unshuffle(block: bytes, size: int) -> bytes:
    """Bytes that are sorted by their place in a value, back in values; what does not fill a value comes last, as it is."""
    n = len(block) // size * size
    return np.frombuffer(block, np.uint8, n).reshape(size, -1).T.tobytes() + block[n:]


def _unshuffle_bits(block: bytes, size: int) -> bytes:
    """The same by bits, for as many values as are a multiple of eight."""
    values = len(block) // size // 8 * 8
    n = values * size
    bits = np.unpackbits(np.frombuffer(block, np.uint8, n), bitorder="little").reshape(size * 8, values)
    return np.packbits(np.ascontiguousarray(bits.T), bitorder="little").tobytes() + block[n:]


def blosc(data: bytes) -> bytes:
    """A container of blosc 1: a header, the offsets of blocks, each block in one or several streams, bytes or bits shuffled."""
    _, _, flags, size, total, block, held = struct.unpack_from("<BBBBIII", data)
    if held > len(data):
        raise ValueError("the blosc container ends early")
    if flags & BLOSC_STORED:
        return data[BLOSC_HEADER : BLOSC_HEADER + total]
    number = flags >> 5
    if number not in BLOSC_LIBRARIES:
        raise UnknownCodecError(f"blosc compressor {number}")
    library, out = BLOSC_LIBRARIES[number], []
    blocks = -(-total // block) if total else 0
    for k, at in enumerate(struct.unpack_from(f"<{blocks}I", data, BLOSC_HEADER)):
        n = min(block, total - k * block)
        # a whole block of wide values is in as many streams as a value has bytes, unless the flags say otherwise
        streams = 1 if flags & BLOSC_WHOLE or n < block or size > 16 or n // size < 128 else size
        parts = []
        for _ in range(streams):
            (packed,) = struct.unpack_from("<i", data, at)
            own = data[at + 4 : at + 4 + packed]
            parts.append(own if packed == n // streams else _unpack(own, library, n // streams))
            at += 4 + packed
        raw = b"".join(parts)
        if flags & BLOSC_SHUFFLE and size > 1:
            raw = _unshuffle(raw, size)
        elif flags & BLOSC_BITS:
            raw = _unshuffle_bits(raw, size)
        out.append(raw)
    return b"".join(out)


def zarr_chunk(raw: bytes, codec: str | None, size: int) -> bytes:
    """The bytes of a zarr chunk by the name of its codec; size: how many there are."""
    if codec is None:
        return raw
    if codec == "blosc":
        return blosc(raw)
    if codec == "zlib":
        return zlib.decompress(raw)
    if codec == "gzip":
        return gzip.decompress(raw)
    if codec == "zstd":
        return bytes(pa.Codec("zstd").decompress(raw, size))
    if codec == "lz4":  # its own length goes ahead of the block
        return bytes(pa.Codec("lz4_raw").decompress(raw[4:], struct.unpack_from("<I", raw)[0]))
    raise UnknownCodecError(f"zarr codec {codec}")
