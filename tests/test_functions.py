"""Scalar functions, matrices, planning and the catalog."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slidespark.functions import geometry as g
from slidespark.functions import scalars as s
from slidespark.plans import catalog as c
from slidespark.plans import levels as lv


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_labels(spark):
    got = one(spark, *(s.mz_label(F.lit(v)) for v in (100, 100.123456, 100.1, 100.9999)))
    assert got == ("m/z 100.000", "m/z 100.123", "m/z 100.100", "m/z 101.000")
    assert one(spark, s.clean_name(F.lit("a.ome.tiff.b.czi")), s.named(F.lit("")), s.named(F.lit(None).cast("string"))) == ("a.b", "unnamed", "unnamed")
    assert one(spark, s.biomarker_name(F.lit("CD3"), F.lit("Opal"), F.lit(2)), s.biomarker_name(F.lit(""), F.lit("DAPI"), F.lit(1))) == ("CD3 - Opal (C2)", "DAPI (C1)")


def test_types_and_units(spark):
    got = one(spark, *(s.integer_type(F.lit(v)) for v in (1, 255, 256, 65535, 65536, 2**32)))
    assert got == ("uint8", "uint8", "uint16", "uint16", "int32", None)
    assert one(spark, s.tiff_resolution(F.lit(2), F.lit(1), F.lit(2)), s.tiff_resolution(F.lit(2), F.lit(1), F.lit(9))) == (12700.0, None)
    assert one(spark, s.svs_resolution(F.lit("a|MPP = 0.2498|b")), s.svs_resolution(F.lit("a|b"))) == (0.2498, 1.0)
    assert one(spark, s.grey(F.lit(255), F.lit(255), F.lit(255))) == (54 + 182 + 18,)
    assert one(spark, s.point_size(F.lit(5001), True), s.point_size(F.lit(50_001), True), s.point_size(F.lit(1), True), s.point_size(F.lit(50_000), False), s.edge_width(F.lit(499))) == (5, 1, 15, 1, 10)


matrices = st.tuples(*(st.floats(-3, 3) for _ in range(6))).filter(lambda v: abs(v[0] * v[4] - v[1] * v[3]) > 0.2).map(lambda v: ((v[0], v[1], v[2]), (v[3], v[4], v[5]), (0.0, 0.0, 1.0)))


@settings(max_examples=50, deadline=None)
@given(matrices, matrices)
def test_matrix_algebra(a, b):
    assert np.allclose(g.compose(a, b), np.array(a) @ np.array(b))
    assert np.allclose(g.compose(a, g.invert(a)), np.eye(3), atol=1e-6)
    assert np.allclose(g.um_to_px(a, 0.5, 2.0), np.diag([0.5, 0.5, 1]) @ np.array(a) @ np.diag([0.5, 0.5, 1]))
    assert np.allclose(g.swap_axes(g.swap_axes(a)), a)


def test_rotation():
    m = np.array(g.centred_rotation(200, 100, 0.5, 90))
    assert np.allclose(m @ [50, 25, 1], [50, 25, 1])
    assert g.rotated_size(200, 100, 90) == (100, 200) and g.rotated_size(200, 100, 0) == (200, 100)
    assert g.is_identity(g.IDENTITY) and not g.is_identity(g.translation(1, 0))
    assert g.matrix_key() == "matrix_yx_px" and g.matrix_key(False, False, True) == "matrix_xy_um_inv"
    with pytest.raises(ValueError):
        g.invert(((1, 1, 0), (1, 1, 0), (0, 0, 1)))
    assert g.affine_bounds(g.translation(5, 0), 10, 20) == (15, 20)


def test_boxes_and_polygons():
    assert g.box_pixels(9.2, 1.7, 3, 8) == (1, 10, 3, 8) and g.box_pixels(1, 2, 3, 4, 0.5) == (2, 4, 6, 8)
    assert g.clamp_box(-5, 2, 20, 20, 15, 10) == (0, 2, 15, 8)
    square = [(0, 0), (4, 0), (4, 4), (0, 4)]
    assert g.simple_polygon(square) and not g.simple_polygon([(0, 0), (4, 4), (4, 0), (0, 4)]) and not g.simple_polygon(square[:2])
    assert g.area(square) == 16


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), min_size=3, max_size=7, unique=True))
def test_inside(spark, polygon):
    points = [(x + 0.5, y + 0.25) for x in range(-1, 22, 3) for y in range(-1, 22, 3)]

    def inside(px, py):
        odd = False
        for (x1, y1), (x2, y2) in zip(polygon, [*polygon[1:], polygon[0]]):
            if (y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1:
                odd = not odd
        return odd

    df = spark.createDataFrame(points, "x double, y double").where(g.in_polygon(polygon, F.col("x"), F.col("y")))
    assert {tuple(r) for r in df.collect()} == {p for p in points if inside(*p)}


def test_levels():
    assert lv.zarr_levels(64, 64, 16) == [(64, 64), (32, 32), (16, 16)]
    assert lv.tiff_levels(4096, 3000, 256) == [(4096, 3000), (2048, 1500), (1024, 750), (512, 375)]
    assert lv.tile_size(3000, 3000) == 1024 and lv.tile_size(600, 600) == 512 and lv.tile_size(100, 100) == 0
    assert lv.pick_level([(4096, 1), (2048, 1), (1024, 1)]) == 2 and lv.pick_level([(4096, 1)]) == -1
    assert lv.thumbnail(1000, 1000, 100) == (100, 100, 10.0, 10.0) and lv.thumbnail(1000, 1000, 2000) == (1000, 1000, 1.0, 1.0)
    assert lv.image_size((10, 20)) == (1, None, (10, 20)) and lv.image_size((7, 10, 20)) == (7, 0, (10, 20)) and lv.image_size((10, 20, 3)) == (3, 2, (10, 20))
    with pytest.raises(ValueError):
        lv.image_size((1, 2, 3, 4))
    assert lv.sort_levels([(1, 1), (4, 4), (2, 2)]) == [1, 2, 0] and lv.level_scale(0.5, (100, 100), (50, 25)) == 1.5
    assert sum(h * w for *_, h, w in lv.tiles(100, 70, 32)) == 7000 and lv.mean_levels(4096, 4096) == [(4096, 4096), (2048, 2048), (1024, 1024)]


def test_catalog(spark):
    k = c.Catalog()
    a = c.Dataset("a-1", "/x/a", spark.range(1), "image", ["DAPI", "FITC-1"], 0.5)
    k.add(a)
    k.add(c.Dataset("b-2", "/x/b", spark.range(2), "points", ["x"]))
    assert k.channel_names() == ["DAPI | a-1", "FITC-1 | a-1", "x | b-2"] and k.names("points") == ["b-2"] and k.resolution == 0.5
    assert k.channel("FITC-1 | a-1") == (a, 1) and a.find_channel("FITC") == 1 and a.channel_index("FITC") == -1 and a.find_channel("no") is None
    assert k.channels(spark).count() == 3 and k.views() == ["a_1", "b_2"] and spark.table("b_2").count() == 2
    k.remove_path("/x/a")
    assert k.names() == ["b-2"]
    t = c.Transforms()
    t.add("m", g.translation(2, 3))
    assert np.allclose(t.matrices["m (inverse)"], g.translation(-2, -3))
    t.remove("m")
    assert list(t.matrices) == ["Identity"]
    assert c.merged_names([["a", "b"], ["c", "d"]], ["p", "q"], [[0], None]) == ["a - p", "c - q", "d - q"]
    with pytest.raises(ValueError):
        c.merged_names([["a"]], n=2)
    assert c.merged_dtype(["uint8", "float32", "uint16"]) == "float32" and c.merged_dtype(["int16"], True) == "uint8"
    assert c.export_name("s", "crop", left=1, right=2, top=3, bottom=4) == "s_x=1-2_y=3-4" and c.export_name("s", "scene", scene=3) == "s_scene=03"
    assert c.dataset_key("/x/a.tiff").startswith("a.tiff-") and c.dataset_key("/x/a", 2).startswith("Scene=2; ")
    assert math.isclose(k.resolution, 1.0)
