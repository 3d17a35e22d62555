"""OME-Zarr folders that grow by channels: appends that die, appends done twice, two writers."""

import json
import threading

import numpy as np
import pytest

from slidespark.sinks import zarr_store
from slidespark.sinks.zarr_store import ZarrStore
from slidespark.sources import zarr


def px_of(spark, image):
    c, y, x = (v.ravel().tolist() for v in np.indices(image.shape))
    return spark.createDataFrame(list(zip(y, x, c, image.astype(float).ravel().tolist(), strict=True)), "y int, x int, channel_id int, value double").repartition(2)


def array_of(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["channel_id"], r["y"], r["x"]] = r["value"]
    return out


def plain(path, level=0):
    """Shape and names as a reader without the log sees them."""
    shape = json.loads((path / str(level) / ".zarray").read_text())["shape"]
    return shape, [c["label"] for c in json.loads((path / ".zattrs").read_text())["omero"]["channels"]]


@pytest.fixture(scope="module")
def image():
    return np.random.default_rng(7).integers(1, 255, (4, 50, 40)).astype("u1")


@pytest.fixture
def store(spark, image, tmp_path):
    s = ZarrStore(spark, str(tmp_path / "g.ome.zarr"))
    s.create(50, 40, "|u1", 16, 0.5)
    assert s.append(px_of(spark, image[:2]), ["a", "b"]) == [0, 1]
    return s


def test_append(spark, image, store, tmp_path):
    assert store.append(px_of(spark, image[2:]), ["c", "d"], "later") == [2, 3]
    px, names, resolution = zarr.read(spark, store.path)
    assert names == ["a", "b", "c", "d"] and resolution == 0.5 and np.array_equal(array_of(px, image.shape), image)
    px, _, resolution = zarr.read(spark, store.path, 1)
    assert resolution == 1.0 and np.array_equal(array_of(px, (4, 25, 20)), image[:, ::2, ::2])
    assert plain(tmp_path / "g.ome.zarr") == ([4, 50, 40], names) and plain(tmp_path / "g.ome.zarr", 1)[0] == [4, 25, 20]
    # the same append again, with other pixels even, is the one that was done
    assert store.append(px_of(spark, image[:2] * 0), ["c", "d"], "later") == [2, 3] and len(store.state.names) == 4
    with pytest.raises(ValueError, match="create"):
        ZarrStore(spark, str(tmp_path / "none.zarr")).append(px_of(spark, image[:1]), ["x"])


def test_other_readers_see_the_published_image(spark, image, store, tmp_path):
    """The folder read without its log."""
    (tmp_path / "g.ome.zarr" / "_commits").rename(tmp_path / "log")
    px, names, resolution = zarr.read(spark, store.path)
    assert names == ["a", "b"] and resolution == 0.5 and np.array_equal(array_of(px, (2, 50, 40)), image[:2])


def test_an_append_that_dies_before_its_commit(spark, image, store, monkeypatch, tmp_path):
    def die(*_):
        raise RuntimeError("power cut")

    monkeypatch.setattr(ZarrStore, "_commit", die)
    with pytest.raises(RuntimeError):
        store.append(px_of(spark, image[2:3]), ["c"], "third")
    monkeypatch.undo()
    px, names, _ = zarr.read(spark, store.path)
    assert names == ["a", "b"] and np.array_equal(array_of(px, (2, 50, 40)), image[:2]) and plain(tmp_path / "g.ome.zarr")[0][0] == 2
    assert store.append(px_of(spark, image[2:3]), ["c"], "third") == [2]
    assert np.array_equal(array_of(zarr.read(spark, store.path)[0], (3, 50, 40)), image[:3])
    assert len(store.vacuum()) >= 1 and store.vacuum() == []
    assert np.array_equal(array_of(zarr.read(spark, store.path)[0], (3, 50, 40)), image[:3])


def test_an_append_that_dies_after_its_commit(spark, image, store, monkeypatch, tmp_path):
    def die(*_):
        raise RuntimeError("power cut")

    monkeypatch.setattr(ZarrStore, "publish", die)
    with pytest.raises(RuntimeError):
        store.append(px_of(spark, image[2:3]), ["c"], "third")
    monkeypatch.undo()
    # complete for readers of the log, not there yet for others
    px, names, _ = zarr.read(spark, store.path)
    assert names == ["a", "b", "c"] and np.array_equal(array_of(px, (3, 50, 40)), image[:3])
    assert plain(tmp_path / "g.ome.zarr")[0][0] == 2
    assert store.append(px_of(spark, image[2:3]), ["c"], "third") == [2]
    assert plain(tmp_path / "g.ome.zarr") == ([3, 50, 40], ["a", "b", "c"])
    assert np.array_equal(array_of(zarr.read(spark, store.path)[0], (3, 50, 40)), image[:3])


def test_two_writers(spark, image, store):
    """Each gets channels of its own, whoever comes first."""
    got, real = {}, zarr_store.latest
    barrier = threading.Barrier(2, timeout=60)
    own = threading.local()

    def together(path):
        found = real(path)
        own.calls = getattr(own, "calls", 0) + 1
        if own.calls == 2:  # both have read the log before either commits
            barrier.wait()
        return found

    def add(name, k):
        got[name] = ZarrStore(spark, store.path).append(px_of(spark, image[k : k + 1]), [name])

    zarr_store.latest = together
    try:
        threads = [threading.Thread(target=add, args=a) for a in (("c", 2), ("d", 3))]
        [t.start() for t in threads]
        [t.join() for t in threads]
    finally:
        zarr_store.latest = real
    assert sorted(v[0] for v in got.values()) == [2, 3]
    px, names, _ = zarr.read(spark, store.path)
    found = array_of(px, (4, 50, 40))
    assert names[got["c"][0]] == "c" and all(np.array_equal(found[got[n][0]], image[k]) for n, k in (("c", 2), ("d", 3)))


def test_an_image_without_channels_and_sparse_channels(spark, tmp_path):
    s = ZarrStore(spark, str(tmp_path / "e.zarr"))
    s.create(20, 20, tile=16)
    px, names, _ = zarr.read(spark, s.path)
    assert names == [] and px.count() == 0
    s.append(spark.createDataFrame([(3, 4, 0, 5.0), (30, 4, 0, 5.0), (3, 4, 7, 5.0), (1, 1, 0, None)], "y int, x int, channel_id int, value double"), ["only", "nothing"])
    found = [tuple(r) for r in zarr.read(spark, s.path)[0].where("value <> 0").collect()]
    assert found == [(3, 4, 0, 5.0)] and zarr.read(spark, s.path)[1] == ["only", "nothing"]


def test_write_zarr_keeps_or_replaces(spark, image, tmp_path):
    path = str(tmp_path / "w.zarr")
    zarr_store.write_zarr(px_of(spark, image[:1]), path, 50, 40, ["a"], tile=16, dtype="|u1")
    zarr_store.write_zarr(px_of(spark, image[1:2]), path, 50, 40, ["b"], tile=16, dtype="|u1")
    assert zarr.read(spark, path)[1] == ["a"]
    zarr_store.write_zarr(px_of(spark, image[1:2]), path, 50, 40, ["b"], tile=16, dtype="|u1", overwrite=True)
    px, names, _ = zarr.read(spark, path)
    assert names == ["b"] and np.array_equal(array_of(px, (1, 50, 40)), image[1:2])
