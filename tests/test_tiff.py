"""Tiles of TIFF files: codecs, what a filter reads, and files that tasks write."""

import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from slidespark.sinks import bigtiff
from slidespark.sources import codecs, tiff
from slidespark.storage import Blocks, read_ranges, runs


def lzw(data: bytes) -> bytes:
    """A plain encoder: the longest known string each time, codes one wider before the table is full to the last but one."""
    bits, width, table = "", 9, {bytes([k]): k for k in range(256)}

    def put(code):
        nonlocal bits
        bits += format(code, f"0{width}b")

    put(256)
    held, size = b"", 258
    for k in range(len(data)):
        more = held + data[k : k + 1]
        if more in table:
            held = more
            continue
        put(table[held])
        table[more] = size
        size += 1
        if size == 4094:
            put(256)
            table, size, width = {bytes([k]): k for k in range(256)}, 258, 9
        elif size + 1 > 1 << width:
            width += 1
        held = data[k : k + 1]
    if held:
        put(table[held])
        size += 1
        if size + 1 > 1 << width and width < 12:
            width += 1
    put(257)
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8))


def test_lzw():
    # a published example of this coding
    assert codecs.lzw(bytes.fromhex("800B6050220C0C8501")) == b"-----A---B"
    rng = np.random.default_rng(0)
    for data in (b"", b"a", b"ab" * 3000, bytes(rng.integers(0, 256, 9000, dtype=np.uint8)), bytes(rng.integers(0, 3, 40000, dtype=np.uint8))):
        assert codecs.lzw(lzw(data)) == data


def test_packbits_and_unknown():
    assert codecs.packbits(bytes([2, 1, 2, 3, 256 - 4, 9, 128, 0, 7])) == bytes([1, 2, 3] + [9] * 5 + [7])
    for bad in (lambda: codecs.tiff_tile(b"", 7, 1), lambda: codecs.zarr_chunk(b"", "jpeg", 1), lambda: codecs.blosc(struct.pack("<BBBBIII", 2, 1, 0, 1, 4, 4, 20) + b"\0" * 4)):
        with pytest.raises(codecs.UnknownCodecError):
            bad()


def test_floating_predictor():
    values = np.random.default_rng(1).normal(size=(4, 6, 1)).astype("<f4")
    rows = []
    for row in values[:, :, 0]:
        planes = np.frombuffer(row.astype(">f4").tobytes(), np.uint8).reshape(-1, 4).T.ravel()
        rows.append(np.diff(planes, prepend=np.uint8(0)).astype(np.uint8).tobytes())
    coded = np.frombuffer(b"".join(rows), "<f4").reshape(4, 6, 1)
    assert np.array_equal(codecs.undo_differences(coded, 3), values)


def container(data: bytes, size: int, block: int, library: str, number: int, shuffle: str = "bytes", split: bool = True) -> bytes:
    """A blosc container made by hand."""
    blocks, bits = [], shuffle == "bits"
    for k in range(0, len(data), block):
        raw = data[k : k + block]
        if bits:
            n = len(raw) // size // 8 * 8 * size
            own = np.unpackbits(np.frombuffer(raw, np.uint8, n), bitorder="little").reshape(-1, size * 8)
            raw = np.packbits(np.ascontiguousarray(own.T), bitorder="little").tobytes() + raw[n:]
        elif shuffle == "bytes":
            n = len(raw) // size * size
            raw = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n).reshape(-1, size).T).tobytes() + raw[n:]
        streams = size if split and len(raw) == block and size <= 16 and len(raw) // size >= 128 else 1
        step, out = len(raw) // streams, b""
        for s in range(0, len(raw), step):
            part = raw[s : s + step]
            packed = zlib.compress(part) if library == "zlib" else bytes(pa.Codec(library).compress(part))
            packed = part if len(packed) >= len(part) else packed
            out += struct.pack("<i", len(packed)) + packed
        blocks.append(out)
    at, offsets = 16 + 4 * len(blocks), []
    for b in blocks:
        offsets.append(at)
        at += len(b)
    flags = number << 5 | {"bytes": 1, "bits": 4, "no": 0}[shuffle] | (0 if split else 16)
    return struct.pack("<BBBBIII", 2, 1, flags, size, len(data), block, at) + struct.pack(f"<{len(blocks)}I", *offsets) + b"".join(blocks)


@pytest.mark.parametrize("library,number", (("lz4_raw", 1), ("zlib", 3), ("zstd", 4)))
def test_blosc(library, number):
    data = (np.arange(5001) // 7).astype("<u2").tobytes()
    for shuffle in ("bytes", "bits", "no"):
        for split in (True, False):
            assert codecs.blosc(container(data, 2, 2048, library, number, shuffle, split)) == data
    noise = bytes(np.random.default_rng(2).integers(0, 256, 3000, dtype=np.uint8))
    assert codecs.blosc(container(noise, 4, 1024, library, number)) == noise
    assert codecs.blosc(struct.pack("<BBBBIII", 2, 1, 2, 1, 5, 5, 21) + b"plain") == b"plain"
    assert codecs.zarr_chunk(container(data, 2, 2048, library, number), "blosc", len(data)) == data
    with pytest.raises(ValueError):
        codecs.blosc(container(data, 2, 2048, library, number)[:-1])


def test_zarr_of_blosc(spark, tmp_path):
    import json

    from slidespark.sources import read

    image = np.random.default_rng(3).integers(0, 999, (2, 40, 48)).astype("<u2")
    root = tmp_path / "b.ome.zarr"
    (root / "0").mkdir(parents=True)
    (root / ".zattrs").write_text(json.dumps({"multiscales": [{"axes": ["c", "y", "x"], "datasets": [{"path": "0"}]}]}))
    (root / "0" / ".zarray").write_text(json.dumps({"shape": [2, 40, 48], "chunks": [1, 20, 32], "dtype": "<u2", "compressor": {"id": "blosc", "cname": "lz4"}, "order": "C"}))
    for c in range(2):
        for j in range(2):
            for i in range(2):
                cell = np.zeros((20, 32), "<u2")
                own = image[c, j * 20 : j * 20 + 20, i * 32 : i * 32 + 32]
                cell[: own.shape[0], : own.shape[1]] = own
                (root / "0" / f"{c}.{j}.{i}").write_bytes(container(cell.tobytes(), 2, 640, "lz4_raw", 1))
    found = np.zeros(image.shape, int)
    for r in read(spark, str(root)).frame.collect():
        found[r["channel_id"], r["y"], r["x"]] = r["value"]
    assert np.array_equal(found, image)


def strips(path, array, method=1, predictor=1, rows=7, big=False):
    """A TIFF of strips, classic or Big, little-endian, one page a channel, packed by hand."""
    pack = {1: bytes, 5: lzw, 8: zlib.compress, 50000: lambda d: bytes(pa.Codec("zstd").compress(d))}[method]
    word, out = ("Q", 8) if big else ("I", 4), bytearray(b"II+\0\x08\0\0\0" + b"\0" * 8 if big else b"II*\0\0\0\0\0")
    last = 8 if big else 4
    code, size = word
    for plane in array:
        offsets, lengths = [], []
        for y in range(0, plane.shape[0], rows):
            part = plane[y : y + rows]
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=part.dtype.type(0))
            raw = pack(np.ascontiguousarray(part).tobytes())
            offsets.append(len(out))
            lengths.append(len(raw))
            out += raw
        places = len(out)
        out += struct.pack(f"<{len(offsets)}{code}", *offsets) + struct.pack(f"<{len(lengths)}{code}", *lengths)
        kind = 16 if big else 4
        n = len(offsets)
        tags = [(256, 4, 1, plane.shape[1]), (257, 4, 1, plane.shape[0]), (258, 3, 1, plane.itemsize * 8), (259, 3, 1, method), (273, kind, n, places if n > 1 else offsets[0]), (277, 3, 1, 1), (278, 4, 1, rows),
                (279, kind, n, places + n * size if n > 1 else lengths[0]), (317, 3, 1, predictor), (339, 3, 1, {"u": 1, "f": 3}[plane.dtype.kind])]
        struct.pack_into(f"<{code}", out, last, len(out))
        out += struct.pack("<Q" if big else "<H", len(tags))
        for tag, k, m, v in tags:
            out += struct.pack("<HHQQ" if big else "<HHII", tag, k, m, v)
        last = len(out)
        out += b"\0" * size
    path.write_bytes(bytes(out))
    return str(path)


def array_of(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["channel_id"], r["y"], r["x"]] = r["value"]
    return out


@pytest.mark.parametrize("method,predictor,big,dtype", ((1, 1, False, "u1"), (5, 1, False, "u1"), (5, 2, True, "u2"), (8, 2, False, "u2"), (50000, 1, True, "f4")))
def test_strips(spark, tmp_path, method, predictor, big, dtype):
    image = np.random.default_rng(4).integers(0, 40, (2, 30, 21)).astype(f"<{dtype}")
    px = tiff.read(spark, strips(tmp_path / "s.tif", image, method, predictor, 7, big))[0]
    assert np.array_equal(array_of(px, image.shape), image)
    assert np.array_equal(array_of(px.where("y >= 8 AND y < 20 AND x = 3 AND channel_id = 1"), image.shape)[1, 8:20, 3], image[1, 8:20, 3])


def test_other_compressions_are_a_typed_error(spark, tmp_path):
    path = tmp_path / "j.tif"
    strips(path, np.zeros((1, 8, 8), "<u1"))
    data = bytearray(path.read_bytes())
    at = data.index(struct.pack("<HHI", 259, 3, 1))
    data[at + 8] = 7
    path.write_bytes(bytes(data))
    with pytest.raises(Exception, match="TIFF compression 7"):
        tiff.read(spark, str(path))[0].collect()


def px_of(spark, image):
    c, y, x = (v.ravel().tolist() for v in np.indices(image.shape))
    return spark.createDataFrame(list(zip(y, x, c, image.astype(float).ravel().tolist(), strict=True)), "y int, x int, channel_id int, value double").repartition(3)


@pytest.fixture(scope="module")
def image():
    return np.random.default_rng(5).integers(0, 9000, (3, 150, 130)).astype("u2")


@pytest.fixture(scope="module")
def written(spark, image, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("big") / "a.ome.tiff")
    return bigtiff.write_ome_tiff(px_of(spark, image), path, 150, 130, ["a", "b", "c"], 0.25, 32, 3, "uint16", differences=True)


def test_big_tiff(spark, image, written):
    px, names, resolution = tiff.read(spark, written)
    assert names == ["a", "b", "c"] and resolution == 0.25 and np.array_equal(array_of(px, image.shape), image)
    for level in (1, 2):
        f = 2**level
        want = image[:, : 150 // f * f, : 130 // f * f].reshape(3, 150 // f, f, 130 // f, f).mean((2, 4)).astype("u2")
        assert np.array_equal(array_of(tiff.read(spark, written, level)[0], want.shape), want)
    header = TiffHeaderOf(written)
    assert header.big and [[p.shape for p in level] for level in header.levels()] == [[(150, 130, 1)] * 3, [(75, 65, 1)] * 3, [(37, 32, 1)] * 3]


def TiffHeaderOf(path):
    return tiff.TiffHeader(Blocks(path))


@pytest.mark.parametrize("compression,rgb", (("none", False), ("zstd", False), ("deflate", True)))
def test_big_tiff_variants(spark, image, tmp_path, compression, rgb):
    path = str(tmp_path / "v.ome.tiff")
    bigtiff.write_ome_tiff(px_of(spark, image), path, 150, 130, ["R", "G", "B"], 1.0, 64, 1, "uint16", rgb, compression)
    assert np.array_equal(array_of(tiff.read(spark, path)[0], image.shape), image)


def test_a_crop_reads_only_its_tiles(spark, image, written):
    """Planned ranges, bytes and rows of a crop, with and without filters."""
    whole = tiff.TiffReader(written, 0, False)
    every = [t for p in whole.partitions() for t in p.tiles]
    assert len(every) == 3 * 5 * 5
    px = tiff.read(spark, written, tiles=True)[0]
    crop = px.where("y >= 40 AND y < 70 AND x >= 100 AND channel_id IN (0, 2)")
    assert np.array_equal(array_of(crop, image.shape)[[0, 2], 40:70, 100:], image[[0, 2], 40:70, 100:].astype(float))
    used = {(r["tile"], r["tile_bytes"]) for r in crop.select("tile", "tile_bytes").distinct().collect()}
    assert len(used) == 2 * 2 * 2 and used <= {(t.offset, t.length) for t in every}
    reader = tiff.TiffReader(written, 0, False)
    from pyspark.sql.datasource import GreaterThanOrEqual, In, LessThan

    list(reader.pushFilters([GreaterThanOrEqual(("y",), 40), LessThan(("y",), 70), GreaterThanOrEqual(("x",), 100), In(("channel_id",), (0, 2))]))
    planned = [t for p in reader.partitions() for t in p.tiles]
    assert {(t.offset, t.length) for t in planned} == used and sum(t.length for t in planned) * 5 < sum(t.length for t in every)
    # a filter that no pixel meets plans nothing
    assert px.where("y > 1000").count() == 0 and px.where("channel_id = 9").count() == 0 and px.where("x = 5 AND x = 6").count() == 0


def test_ranges(tmp_path):
    data = bytes(range(256)) * 40
    (tmp_path / "f").write_bytes(data)
    ranges = [(5000, 10), (10, 20), (40, 5), (9000, 100), (10, 20)]
    assert [sorted(r) for r in runs(ranges, gap=16)] == [[1, 2, 4], [0], [3]]
    assert dict(read_ranges(str(tmp_path / "f"), ranges, 16)) == {k: data[a : a + n] for k, (a, n) in enumerate(ranges)}
    with pytest.raises(ValueError, match="ends within"):
        list(read_ranges(str(tmp_path / "f"), [(10_200, 100)]))
    blocks = Blocks(str(tmp_path / "f"), 64)
    assert blocks.read(60, 10) == data[60:70] and blocks.bytes_read == 128 and blocks.read(64, 8) == data[64:72] and blocks.bytes_read == 128


def test_parts_can_be_written_twice(spark, image, tmp_path):
    """A task that runs again changes nothing; a write that fails leaves what was there."""
    path, layout = str(tmp_path / "r.ome.tiff"), bigtiff.Layout(150, 130, 3, "uint16", 32)
    tiles = bigtiff.encode_tiles(px_of(spark, image), layout)
    bigtiff.write_parts(tiles, path, layout, ["a", "b", "c"])
    before = open(path, "rb").read()
    lengths = {r["part"]: r["n"] for r in tiles.groupBy("part").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    base, end = {}, bigtiff.HEADER
    for part in sorted(lengths):
        base[part], end = end, end + lengths[part]
    for _ in range(2):
        tiles.select("part", "at", "data").mapInArrow(bigtiff._place(path, base), "bytes long").collect()
    assert open(path, "rb").read() == before
    with pytest.raises(AttributeError):
        bigtiff.write_parts(tiles, path, layout, [None])
    assert open(path, "rb").read() == before and [f.name for f in tmp_path.iterdir()] == ["r.ome.tiff"]
    assert bigtiff.write_ome_tiff(px_of(spark, image * 0), path, 150, 130, ["a", "b", "c"], tile=32) == path and open(path, "rb").read() == before


def test_sparse_and_stray_pixels(spark, tmp_path):
    """Tiles without pixels take no room; pixels outside the image and nulls are left out."""
    rows = [(0, 0, 0, 7.0), (99, 99, 1, 8.0), (100, 0, 0, 9.0), (0, -1, 0, 9.0), (5, 5, 2, 9.0), (6, 6, 0, None)]
    px = spark.createDataFrame(rows, "y int, x int, channel_id int, value double")
    path = bigtiff.write_ome_tiff(px, str(tmp_path / "s.ome.tiff"), 100, 100, ["a", "b"], tile=32)
    found = array_of(tiff.read(spark, path)[0], (2, 100, 100))
    want = np.zeros((2, 100, 100))
    want[0, 0, 0], want[1, 99, 99] = 7, 8
    assert np.array_equal(found, want)
    assert sum(1 for t in tiff.tiles(TiffHeaderOf(path).pages[0], 0, tiff.Box()) if t.length) == 1
    empty = bigtiff.write_ome_tiff(px.limit(0), str(tmp_path / "e.ome.tiff"), 40, 40, ["a"], tile=32)
    assert np.array_equal(array_of(tiff.read(spark, empty)[0], (1, 40, 40)), np.zeros((1, 40, 40)))
    for bad in (lambda: bigtiff.Layout(9, 9, 1, "uint8", 20), lambda: bigtiff.Layout(9, 9, 1, "float32", 16, differences=True), lambda: bigtiff.Layout(9, 9, 1, "uint8", 16, compression="jpeg")):
        with pytest.raises(ValueError):
            bad()


def test_channels_one_by_one(spark, image, tmp_path):
    path, px = str(tmp_path / "c.ome.tiff"), px_of(spark, image)
    w = bigtiff.ChannelWriter(150, 130, "uint16", 32, 2)
    with pytest.raises(ValueError, match="no channel"):
        w.write(path)
    assert [w.add(px.where(f"channel_id = {c}"), n) for c, n in ((2, "third"), (0, "first"))] == [0, 1]
    with pytest.raises(ValueError, match="already"):
        w.add(px, "third")
    w.write(path)
    found, names, _ = tiff.read(spark, path)
    assert names == ["third", "first"] and np.array_equal(array_of(found, (2, 150, 130)), image[[2, 0]])
    w.add(px.where("channel_id = 1"), "second")
    assert w.write(path) == path and tiff.read(spark, path)[1] == ["third", "first"]
    w.write(path, overwrite=True)
    found, names, _ = tiff.read(spark, path)
    assert names == ["third", "first", "second"] and np.array_equal(array_of(found, (3, 150, 130)), image[[2, 0, 1]])
    assert array_of(tiff.read(spark, path, 1)[0], (3, 75, 65)).shape == (3, 75, 65)


def test_levels_as_pages(spark, tmp_path):
    """A pyramid of further pages, with a picture of another shape between them."""
    rng = np.random.default_rng(6)
    parts = [rng.integers(0, 99, s).astype("<u1") for s in ((1, 64, 48), (1, 20, 30), (1, 32, 24), (1, 16, 12))]
    paths = [strips(tmp_path / f"{k}.tif", p, rows=64) for k, p in enumerate(parts)]
    pages = []
    for p in paths:
        pages += TiffHeaderOf(p).pages
    header = TiffHeaderOf(paths[0])
    header.pages = pages
    assert [level[0].shape[:2] for level in header.levels()] == [(64, 48), (32, 24), (16, 12)]
