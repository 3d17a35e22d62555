"""Round trips through sources and sinks, streaming and the command line."""

import json
import sqlite3
import zipfile

import numpy as np
import pytest

from slidespark import cli, streaming
from slidespark.operators import vectors
from slidespark.sinks import images, text
from slidespark.sinks.zarr_store import write_zarr
from slidespark.sources import UnsupportedFormatError, geojson, imzml, is_supported, kind_of, read, spectra, tiff


def array(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["channel_id"], r["y"], r["x"]] = r["value"]
    return out


@pytest.fixture(scope="module")
def image():
    return np.random.default_rng(0).integers(0, 255, (3, 70, 90)).astype(np.uint8)


def pixels_of(spark, image):
    return spark.createDataFrame([(int(y), int(x), int(c), float(v)) for (c, y, x), v in np.ndenumerate(image)], "y int, x int, channel_id int, value double")


def test_kinds():
    assert kind_of("a.OME.TIFF") == "tiff" and kind_of("b.ome.zarr/") == "zarr" and is_supported("p.csv") and not is_supported("s.czi")
    with pytest.raises(UnsupportedFormatError):
        kind_of("a.doc")


@pytest.mark.parametrize("dtype", ("uint8", "uint16", "float32"))
def test_tiff(spark, tmp_path, image, dtype):
    path = str(tmp_path / "a.ome.tiff")
    data = image.astype(dtype) * (3 if dtype != "uint8" else 1)
    images.write_tiff(data, path, ["DAPI", "FITC", "x & y"], 0.25, 32, 2)
    d = read(spark, path)
    assert d.resolution == 0.25 and d.channels[:2] == ["DAPI", "FITC"] and np.array_equal(array(d.frame, data.shape), data)
    low = array(tiff.read(spark, path, 1)[0], (3, 35, 45))
    assert np.array_equal(low[0], data[0].reshape(35, 2, 45, 2).mean((1, 3)).astype(dtype))
    images.write_tiff(data * 0, path, ["a", "b", "c"])
    assert np.array_equal(array(read(spark, path).frame, data.shape), data)


def test_tiff_rgb(spark, tmp_path, image):
    path = str(tmp_path / "rgb.tif")
    images.write_tiff(image, path, ["R", "G", "B"], rgb=True, tile=64)
    assert np.array_equal(array(read(spark, path).frame, image.shape), image)


def test_zarr(spark, tmp_path):
    data = np.random.default_rng(1).integers(0, 255, (2, 72, 80)).astype(np.uint8)
    path = write_zarr(pixels_of(spark, data), str(tmp_path / "z.ome.zarr"), 72, 80, ["one", "two"], 0.75, 16, "|u1")
    d = read(spark, path)
    assert d.channels == ["one", "two"] and d.resolution == 0.75 and np.array_equal(array(d.frame, data.shape), data)
    attrs = json.loads((tmp_path / "z.ome.zarr" / ".zattrs").read_text())
    assert len(attrs["multiscales"][0]["datasets"]) == 3


def test_arrays_and_png(spark, tmp_path, image):
    np.save(tmp_path / "a.npy", image[0])
    assert np.array_equal(array(read(spark, str(tmp_path / "a.npy")).frame, (1, 70, 90))[0], image[0])
    np.savez(tmp_path / "b.npz", array=np.moveaxis(image, 0, 2), labels=np.array(["p", "q", "r"]))
    d = read(spark, str(tmp_path / "b.npz"))
    assert d.channels == ["p", "q", "r"] and np.array_equal(array(d.frame, image.shape), image)
    (tmp_path / "c.png").write_bytes(images.png(np.moveaxis(image, 0, 2)))
    assert np.array_equal(array(read(spark, str(tmp_path / "c.png")).frame, image.shape), image)


def test_geojson(spark, tmp_path):
    ring = [[0, 0], [4, 0], [4, 4], [0, 0]]
    features = [
        {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [ring, [[1, 1], [2, 1], [2, 2], [1, 1]]]}, "properties": {"classification": {"name": "cell"}}},
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [7, 8]}},
        {"type": "Feature", "geometry": {"type": "MultiPoint", "coordinates": [[1, 2], [3, 4]]}, "properties": None},
    ]
    path = tmp_path / "s.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    v = read(spark, str(path)).frame
    assert [(r["shape_name"], r["shape_type"], r["count"]) for r in v.groupBy("shape_idx", "shape_name", "shape_type").count().orderBy("shape_idx").collect()] == [
        ("cell", "polygon", 4), ("cell", "polygon", 4), ("unnamed", "point", 1), ("unnamed", "points", 2),
    ]
    with zipfile.ZipFile(tmp_path / "s.zip", "w") as z:
        z.writestr("a.json", json.dumps(features[1]))
    assert read(spark, str(tmp_path / "s.zip")).frame.count() == 1
    with pytest.raises(ValueError):
        geojson.shapes_of({"geometry": {"type": "GeometryCollection"}})
    lines = [json.loads(r["feature"]) for r in text.feature_lines(vectors.nested(v.where("shape_idx = 0"))).collect()]
    assert lines[0]["geometry"]["coordinates"][0] == [[float(a) for a in p] for p in ring] and lines[0]["properties"]["classification"]["name"] == "cell"
    assert geojson.feature([(0, 0), (1, 0), (1, 1)])["geometry"]["coordinates"][0][-1] == [0.0, 0.0]


def test_tables(spark, tmp_path):
    for name, sep in (("a.csv", ","), ("b.txt", " "), ("c.tsv", "\t")):
        (tmp_path / name).write_text("\n".join(sep.join(r) for r in (("x", "y", "label"), ("1", "2", "a"), ("3", "4", "b"))))
        d = read(spark, str(tmp_path / name))
        assert d.kind == "points" and sorted(tuple(r) for r in d.frame.collect()) == [(1.0, 2.0, "a"), (3.0, 4.0, "b")]
    (tmp_path / "s.csv").write_text("vertex_x,vertex_y,cell\n1,2,p\n3,4,q\n5,6,p\n")
    assert read(spark, str(tmp_path / "s.csv")).kind == "shapes"


def test_spectral_sources(spark, tmp_path):
    cv = '<cvParam accession="%s" value="%s"/>'
    body = "".join(f"<spectrum>{cv % (imzml.POSITION_X, x)}{cv % (imzml.POSITION_Y, y)}{cv % (imzml.TOTAL, x * y)}</spectrum>" for x in (1, 2) for y in (3, 4))
    (tmp_path / "a.imzml").write_text(f"<mzML><run>{body}</run></mzML>")
    assert sorted((r["x"], r["y"], r["value"]) for r in read(spark, str(tmp_path / "a.imzml")).frame.collect()) == [(1, 3, 3.0), (1, 4, 4.0), (2, 3, 6.0), (2, 4, 8.0)]
    (tmp_path / "b.d").mkdir()
    with sqlite3.connect(tmp_path / "b.d" / "analysis.tsf") as db:
        db.executescript("CREATE TABLE MaldiFrameInfo (Frame, RegionNumber, XIndexPos, YIndexPos, LaserInfo); CREATE TABLE Frames (Id, SummedIntensities); CREATE TABLE MaldiFrameLaserInfo (Id, SpotSize);"
                         "INSERT INTO MaldiFrameInfo VALUES (2, 0, 10, 20, 1), (1, 1, 15, 22, 1); INSERT INTO Frames VALUES (1, 5.0), (2, 7.0); INSERT INTO MaldiFrameLaserInfo VALUES (1, 50.0);")  # fmt: skip
    d = read(spark, str(tmp_path / "b.d"))
    assert d.resolution == 50.0 and sorted((r["y"], r["x"], r["value"]) for r in d.frame.collect()) == [(0, 0, 7.0), (2, 5, 5.0)]
    assert {(r["region"], r["x"], r["y"]) for r in spectra.read_regions(spark, str(tmp_path / "b.d")).collect()} == {(0, 0, 0), (1, 0, 0)}


def test_fusion(spark, tmp_path):
    px = pixels_of(spark, np.array([[[1.0, 2.0]], [[3.5, 4.0]]]))
    text.write_fusion(px, str(tmp_path / "f"), [0, 1], ["a", "b"])
    assert [r[0] for r in spark.read.text(str(tmp_path / "f")).collect()] == ["row,col,a,b,", "1,1,1.00,3.50,", "1,2,2.00,4.00,"]


def test_streaming(spark, tmp_path):
    src = str(tmp_path / "in")
    pixels_of(spark, np.ones((2, 3, 3))).write.parquet(src)
    q = streaming.channel_summary(streaming.pixel_stream(spark, src)).writeStream.outputMode("complete").format("memory").queryName("summary").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["channel_id"], r["n"], r["total"]) for r in spark.table("summary").collect()} == {(0, 9, 9.0), (1, 9, 9.0)}
    streaming.write_files(streaming.pixel_stream(spark, src), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 18
    events = spark.readStream.schema(spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema).parquet("/root/testdata/sf0.001/events.parquet")
    assert "window" in streaming.event_windows(events.withColumn("ts", events.ts.cast("timestamp"))).columns


def test_cli(spark, tmp_path, image, capsys):
    src = str(tmp_path / "a.ome.tiff")
    images.write_tiff(image, src, ["a", "b", "c"])
    assert cli.main(["info", src]) == 0 and json.loads(capsys.readouterr().out.strip().splitlines()[-1])["channels"] == ["a", "b", "c"]
    out = tmp_path / "out"
    out.mkdir()
    assert cli.main(["crop", src, "-o", str(out), "--box", "10", "40", "5", "25"]) == 0
    assert np.array_equal(array(read(spark, str(out / "a_x=10-40_y=5-25.ome.tiff")).frame, (3, 20, 30)), image[:, 5:25, 10:40])
    assert cli.main(["thumbnail", src, "-o", str(out / "t.png"), "--size", "45"]) == 0 and (out / "t.png").read_bytes()[:4] == b"\x89PNG"
    assert cli.main(["merge", src, src, "-o", str(out), "--fmt", "ome-zarr"]) == 0
    assert len(read(spark, str(out / "a_merged-registered.ome.zarr")).channels) == 6
    assert cli.main(["combine", src, src, "-o", str(out), "--how", "sum"]) == 0
    assert np.array_equal(array(read(spark, str(out / "a-sum.ome.tiff")).frame, image.shape), image.astype(float) * 2)
    with pytest.raises(SystemExit):
        cli.main(["mask", src, "-o", str(out)])
