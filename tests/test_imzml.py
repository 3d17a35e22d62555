"""imzML by its index, and the store of centroids, against whole arrays."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from slidespark.sources import imzml


def write(folder, spectra, shared=None, packed=False):
    """An imzML file and its binary; spectra: (y, x, mz, intensity).  shared: one m/z array for all."""
    cv = '<cvParam accession="{}" value="{}"/>'.format
    data, body = bytearray(16), []

    def array(kind, values, dtype, place=None):
        raw = np.asarray(values, dtype).tobytes()
        raw = zlib.compress(raw) if packed else raw
        if place is None:
            place = len(data)
            data.extend(raw)
        more = cv(imzml.EXTERNAL_OFFSET, place) + cv(imzml.EXTERNAL_LENGTH, len(values)) + cv(imzml.EXTERNAL_BYTES, len(raw))
        return place, f'<binaryDataArray><referenceableParamGroupRef ref="{kind}"/>{more}<binary/></binaryDataArray>'

    first = array("m", shared, "<f8")[0] if shared is not None else None
    for y, x, mz, intensity in spectra:
        own = array("m", mz if shared is None else shared, "<f8", first)[1] + array("i", intensity, "<f4")[1]
        body.append(f"<spectrum>{cv(imzml.TOTAL, float(np.sum(intensity)))}<scanList><scan>{cv(imzml.POSITION_X, x)}{cv(imzml.POSITION_Y, y)}</scan></scanList><binaryDataArrayList>{own}</binaryDataArrayList></spectrum>")
    code = cv(imzml.ZLIB, "") if packed else cv("MS:1000576", "")
    groups = "".join(f'<referenceableParamGroup id="{k}">{cv(a, "")}{cv(t, "")}{code}</referenceableParamGroup>' for k, a, t in (("m", imzml.MZ_ARRAY, "MS:1000523"), ("i", imzml.INTENSITY_ARRAY, "MS:1000521")))
    path = str(folder / "s.imzML")
    (folder / "s.imzML").write_text(f'<mzML xmlns="http://psi.hupo.org/ms/mzml"><referenceableParamGroupList>{groups}</referenceableParamGroupList><run>{"".join(body)}</run></mzML>')
    (folder / "s.ibd").write_bytes(bytes(data))
    return path


def whole(spectra, targets, ppm):
    out = {}
    for y, x, mz, intensity in spectra:
        for k, t in enumerate(targets):
            at = np.abs(mz - t) <= t * ppm * 1e-6
            if at.any():
                out[y, x, k] = float(np.asarray(intensity, np.float32)[at].astype(float).sum())
    return out


@pytest.fixture(scope="module")
def spectra():
    rng = np.random.default_rng(0)
    return [(y, x, np.sort(rng.uniform(100, 1000, 3000)), rng.uniform(0, 9, 3000)) for y in range(1, 5) for x in range(1, 7)]


TARGETS = [250.0, 250.01, 700.5, 99_999.0]


@pytest.mark.parametrize("mode", ("own", "shared", "packed"))
def test_ion_images(spark, spectra, tmp_path, mode):
    if mode == "shared":
        spectra = [(y, x, spectra[0][2], i) for y, x, _, i in spectra]
    path = write(tmp_path, spectra, spectra[0][2] if mode == "shared" else None, mode == "packed")
    index = imzml.index(spark, path)
    assert index.count() == 24 and index.where("mz_n = 3000 AND intensity_type = '<f4' AND mz_type = '<f8'").count() == 24
    assert index.select("mz_at").distinct().count() == (1 if mode == "shared" else 24)
    binary = imzml.binary_of(path)
    found = {(r["y"], r["x"], r["channel_id"]): r["value"] for r in imzml.ion_images(index, binary, TARGETS, 80.0).collect()}
    want = whole(spectra, TARGETS, 80.0)
    assert found.keys() == want.keys() and all(abs(found[k] - v) < 1e-6 for k, v in want.items())
    every = imzml.peaks(index, binary)
    assert every.count() == 24 * 3000 and every.agg(F.countDistinct("y", "x")).first()[0] == 24
    size = (tmp_path / "s.ibd").stat().st_size
    read = imzml.peaks(index, binary, TARGETS, 80.0, with_bytes=True).agg(F.sum("bytes_read")).first()[0]
    # m/z arrays once, and hardly any intensities
    assert read < size * {"own": 0.7, "shared": 0.35, "packed": 1.0}[mode]
    assert imzml.peaks(index, binary, with_bytes=True).agg(F.sum("bytes_read")).first()[0] == size - 16


def test_spectra_without_arrays_and_short_files(spark, spectra, tmp_path):
    path = write(tmp_path, [(1, 1, np.array([]), np.array([])), *spectra[:2]])
    index = imzml.index(spark, path)
    assert imzml.peaks(index, imzml.binary_of(path)).count() == 6000
    assert imzml.peaks(index.limit(0), imzml.binary_of(path), TARGETS).count() == 0
    data = (tmp_path / "s.ibd").read_bytes()
    (tmp_path / "s.ibd").write_bytes(data[:-1000])
    with pytest.raises(Exception, match="ends within"):
        imzml.peaks(index, imzml.binary_of(path)).count()


def test_windows():
    mz = np.array([1.0, 2, 3, 4, 5, 6])
    assert imzml._windows(mz, np.array([0.5, 2.0, 5.5, 9]), np.array([2.5, 3.0, 5.7, 10])) == [(0, 3)]
    assert imzml._windows(mz, np.array([5, 1.0]), np.array([7, 1.0])) == [(0, 1), (4, 6)]


def test_centroid_store(spark, spectra, tmp_path):
    rows = [(y, x, float(m), float(np.float32(i))) for y, x, mz, intensity in spectra for m, i in zip(mz, intensity, strict=True)]
    table = spark.createDataFrame(rows, imzml.PEAKS).repartition(4)
    path = str(tmp_path / "store")
    bounds = imzml.write_centroids(table, path, 16).orderBy("low").collect()
    assert len(bounds) >= 8 and sum(b["n"] for b in bounds) == len(rows) and all(a["high"] < b["low"] for a, b in zip(bounds, bounds[1:], strict=False))
    assert len(imzml.centroid_files(spark, path, [700.5], 80.0)) <= 2 and imzml.centroid_files(spark, path, [99_999.0]) == []
    images = imzml.centroid_images(spark, path, TARGETS, 80.0)
    found = {(r["y"], r["x"], r["channel_id"]): r["value"] for r in images.collect()}
    want = whole(spectra, TARGETS, 80.0)
    assert found.keys() == want.keys() and all(abs(found[k] - v) < 1e-6 for k, v in want.items())
    assert imzml.centroid_images(spark, path, [99_999.0]).count() == 0
    assert len({f.rsplit("/", 1)[-1] for f in imzml.centroid_images(spark, path, [700.5], 80.0).inputFiles()}) <= 2
