"""Pixel, shape and spectrum operators against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slidespark.functions import geometry as g
from slidespark.operators import pixels, spectra, vectors

H, W, C = 8, 9, 2


@pytest.fixture(scope="module")
def image():
    return np.round(np.random.default_rng(0).random((C, H, W)) * 100, 3)


def frame(spark, image):
    return spark.createDataFrame([(int(y), int(x), int(c), float(v)) for (c, y, x), v in np.ndenumerate(image)], "y int, x int, channel_id int, value double")


def array(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["channel_id"] if len(shape) == 3 else slice(None), r["y"], r["x"]] = np.nan if r["value"] is None else r["value"]
    return out


@pytest.fixture(scope="module")
def px(spark, image):
    return frame(spark, image).cache()


def test_crop_and_mask(px, image):
    assert np.array_equal(array(pixels.crop(px, 2, 6, 3, 7), (C, 4, 4)), image[:, 3:7, 2:6])
    assert np.array_equal(array(pixels.crop(px, -3, 3, -1, 50), (C, H, 3)), image[:, :, :3])
    inside = np.zeros((H, W), bool)
    inside[3:7, 2:6] = True
    assert np.array_equal(array(pixels.mask(px, pixels.in_box(2, 6, 3, 7)), image.shape), image * inside)


def test_reduce(px, image):
    for how, f in (("sum", np.sum), ("mean", np.mean), ("max", np.max)):
        got = {(r["y"], r["x"]): r["value"] for r in pixels.reduce_channels(px, how).collect()}
        assert all(abs(got[y, x] - v) < 1e-9 for (y, x), v in np.ndenumerate(f(image, axis=0)))


def test_rescale(px, image, spark):
    low, high = image.min((1, 2), keepdims=True), image.max((1, 2), keepdims=True)
    assert np.array_equal(array(pixels.rescale_uint8(px), image.shape), np.clip((image - low) / (high - low) * 255, 0, 255).astype(np.uint8))
    flat = frame(spark, np.full((1, 2, 2), 7.0))
    assert {r["value"] for r in pixels.rescale_uint8(flat).collect()} == {0}


def test_levels(px, image):
    want = image[:, :, : W // 2 * 2].reshape(C, H // 2, 2, W // 2, 2).mean((2, 4))
    assert np.allclose(array(pixels.block_mean(px, 2, W, H), want.shape), want)
    assert np.array_equal(array(pixels.nearest_level(px, 2), (C, 4, 5)), image[:, ::2, ::2])


def test_histogram(px, image, spark):
    other = image[:, ::-1] ** 2
    got = array(pixels.match_histogram(px, frame(spark, other)), image.shape)
    for c in range(C):
        def cut(a):
            return np.minimum(255, np.floor((a - a.min()) / (a.max() - a.min()) * 256)).astype(int) if a.max() > a.min() else np.zeros(a.shape, int)

        s, r = cut(image[c]), cut(other[c])
        cs, cr = (np.bincount(b.ravel(), minlength=256).cumsum() / b.size for b in (s, r))
        lut = np.array([np.searchsorted(cr, v - 1e-12, "left") for v in cs]).clip(0, 255)
        assert np.allclose(got[c], image[c].min() + lut[s] / 255 * np.ptp(image[c]))


@pytest.mark.parametrize("order", (0, 1))
def test_warp(px, image, order):
    m = ((0.913, -0.207, 1.0131), (0.1517, 1.1093, -0.5239), (0.0, 0.0, 1.0))
    inv = np.linalg.inv(np.array(m))
    want = np.zeros((C, 10, 11))
    for y in range(10):
        for x in range(11):
            sx, sy, _ = inv @ [x, y, 1]
            if order == 0:
                cells = [(int(np.rint(sy)), int(np.rint(sx)), 1.0)]
            else:
                iy, ix = int(np.floor(sy)), int(np.floor(sx))
                cells = [(iy + dy, ix + dx, (sx - ix if dx else 1 - sx + ix) * (sy - iy if dy else 1 - sy + iy)) for dy in (0, 1) for dx in (0, 1)]
            for a, b, w in cells:
                if 0 <= a < H and 0 <= b < W:
                    want[:, y, x] += w * image[:, a, b]
    assert np.allclose(array(pixels.warp(px, m, 11, 10, order), want.shape), want)


def test_flip_and_resize(px, image):
    assert np.array_equal(array(pixels.warp(px, g.flip(W, H, True, True), W, H), image.shape), image[:, ::-1, ::-1])
    assert np.allclose(array(pixels.resize(px, W, H, W, H), image.shape), image)


def test_scatter_takes_the_whole_table(spark):
    from slidespark.plans import model
    from slidespark.registry import QUERIES

    d = "/root/testdata/sf0.001"
    sparse = model.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct().toPandas()
    got = QUERIES["scatter_table"](spark, d).toPandas()
    spans = [int(sparse[c].max() - sparse[c].min()) + 1 for c in sparse]
    assert len(got) == spans[0] * spans[1] and got["value"].notna().sum() == len(sparse)


def test_scatter_and_stitch(spark):
    p = spark.createDataFrame([(5, 7, 1.0, 1), (6, 9, 2.0, 2), (5, 7, 3.0, 3)], "y int, x int, value double, ord int")
    got = {(r["y"], r["x"]): r["value"] for r in pixels.scatter(p).collect()}
    assert len(got) == 6 and got[0, 0] == 3.0 and got[1, 2] == 2.0 and got[0, 1] is None
    s = spark.createDataFrame([(0, 0, 0, 0, 5.0, -2, 1), (1, 0, 0, 0, 3.0, -2, 1), (1, 0, 1, 0, 4.0, -2, 1)], "scene_index int, y int, x int, channel_id int, value double, x0 int, y0 int")
    assert {(r["y"], r["x"]): r["value"] for r in pixels.stitch(s).collect()} == {(0, 0): 5.0, (0, 1): 4.0}
    assert {(r["y"], r["x"]): r["value"] for r in pixels.stitch(s, "last").collect()} == {(0, 0): 3.0, (0, 1): 4.0}


def test_fill_and_normalise(spark):
    df = spark.createDataFrame([(0, 0, 0, 1.0), (0, 1, 0, float("nan")), (0, 2, 0, None), (0, 3, 0, 5.0)], "y int, x int, channel_id int, value double")
    assert [r["value"] for r in pixels.fill_missing(df).orderBy("x").collect()] == [1, 1, 1, 5]
    assert [r["value"] for r in pixels.fill_missing(df, "median").orderBy("x").collect()] == [1, 3, 3, 5]
    assert [r["value"] for r in pixels.fill_missing(df, 9).orderBy("x").collect()] == [1, 9, 9, 5]
    norm = spark.createDataFrame([(0, 0, 2.0), (0, 3, 0.0)], "y int, x int, norm double")
    assert [r["value"] for r in pixels.normalise(df, norm).orderBy("x").collect()] == [0.5, None, None, None]


def test_rasterise(spark):
    shapes = [((1.0, 1.0), (6.0, 1.0), (6.0, 5.0), (1.0, 5.0)), ((4.0, 2.0), (9.0, 4.0), (3.0, 8.0))]
    table = spark.createDataFrame([(k, i, *v) for k, s in enumerate(shapes) for i, v in enumerate(s)], "shape_idx int, i int, x double, y double")
    by_table = {}
    for r in pixels.rasterise_table(table).collect():
        by_table[r["y"], r["x"]] = max(by_table.get((r["y"], r["x"]), 0), r["shape_idx"] + 1)
    assert by_table == {(r["y"], r["x"]): r["value"] for r in pixels.rasterise(spark, shapes, 12, 12).collect()}
    a = {r["shape_idx"]: (r["area"], r["valid"]) for r in vectors.polygon_areas(table).collect()}
    assert a == {k: (g.area(s), True) for k, s in enumerate(shapes)}


def test_fit_affine(spark):
    rng = np.random.default_rng(1)
    m = np.array([[1.16, -0.015, -37.7], [0.009, 0.907, 31.2]])
    p = rng.random((20, 2)) * 500
    q = p @ m[:, :2].T + m[:, 2]
    fit = vectors.fit_affine(spark.createDataFrame([(*map(float, a), *map(float, b)) for a, b in zip(p, q)], "mx double, my double, fx double, fy double")).first()
    assert np.allclose([[fit[f"m{i}{j}"] for j in range(3)] for i in range(2)], m, atol=1e-8)


def test_points_and_shapes(spark):
    df = spark.createDataFrame([(1, 2, "a"), (3, 4, "b"), (5, 6, "a")], "x_location int, y_location int, feature_name string")
    assert [tuple(r) for r in vectors.points(df).orderBy("x").collect()] == [(1.0, 2.0, "a"), (3.0, 4.0, "b"), (5.0, 6.0, "a")]
    assert {r["name"] for r in vectors.feature_names(df).collect()} == {"a", "b"} and vectors.has_columns(df, ("feature_name",), (("x", "x_location"),))
    with pytest.raises(ValueError):
        vectors.points(df.select("feature_name"))
    v = spark.createDataFrame([(0, 9.0, 1.0, "q"), (1, 2.0, 3.0, "p"), (2, 4.0, 5.0, "q")], "_row int, vertex_x double, vertex_y double, cell string")
    shapes = vectors.vertices(v, ["_row"])
    assert sorted(tuple(r) for r in shapes.select("shape_idx", "shape_name", "i", "x").collect()) == [(0, "q", 0, 9.0), (0, "q", 1, 4.0), (1, "p", 0, 2.0)]
    assert {r["shape"] for r in vectors.shape_table(shapes).collect()} == {"q-0", "p-1"}
    assert [(s["x"], s["y"]) for s in vectors.nested(vectors.swap_axes(shapes)).where("shape_idx = 0").first()["vertices"]] == [(1.0, 9.0), (5.0, 4.0)]


def test_extract(spark):
    peaks = spark.createDataFrame([(1, 100.0, 1.0), (1, 100.0009, 2.0), (1, 100.0011, 4.0), (2, 99.9991, 8.0), (2, 500.0, 16.0)], "frame int, mz double, intensity double")
    got = {(r["target"], r["frame"]): r["intensity"] for r in spectra.extract(peaks, [100.0, 500.001], 10.0).collect()}
    assert got == {(100.0, 1): 3.0, (100.0, 2): 8.0, (500.001, 2): 16.0}


def test_plans_push_down(spark):
    """A channel or a crop reads what it needs: predicates on pixels reach the scan as columns, and no row meets all polygons."""
    from slidespark.plans import model

    plan = model.channel(spark, "/root/testdata/sf0.001", 3)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "label" not in plan.split("ReadSchema")[1]
    cut = pixels.crop_polygon(model.px(spark, "/root/testdata/sf0.001"), model.POLYGON)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in cut and "Exchange" not in cut and F is not None
