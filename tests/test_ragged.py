"""Registered queries over images that lack pixels and points that lie beyond the image, against their SQL."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slidespark.functions import xml
from slidespark.plans import model
from slidespark.registry import ORACLE_SQL, QUERIES
from slidespark.sinks import bigtiff
from slidespark.sinks.zarr_store import ZarrStore
from slidespark.sources import tiff, zarr


def same(spark, d, name):
    """How many rows the query and its SQL give, which are the same ones."""
    db = duckdb.connect()
    for t in ("embeddings", "events"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    got, want = QUERIES[name](spark, d).toPandas(), db.sql(ORACLE_SQL[name]).df()
    cols = sorted(want.columns)
    a, b = (sorted(tuple(map(str, r)) for r in df[cols].itertuples(index=False)) for df in (got, want))
    assert sorted(got.columns) == cols and a == b
    return len(a)


@pytest.fixture(scope="module")
def ragged(tmp_path_factory):
    """Three rows of pixels, the last one not full, with a hole in the second."""
    d = tmp_path_factory.mktemp("ragged")
    ids = [k for k in range(57) if k not in (30, 31, 40)]
    values = np.random.default_rng(11).normal(size=(len(ids), 64)).astype("f4")
    pd.DataFrame({"vec_id": ids, "label": [k % 3 for k in ids], "embedding": list(values)}).to_parquet(d / "embeddings.parquet")
    pd.DataFrame({"event_id": [0], "user_id": [0], "value": [1.0]}).to_parquet(d / "events.parquet")
    return str(d)


def test_flip_h(spark, ragged):
    assert same(spark, ragged, "flip_h") == 54 * 64


def test_flip_v(spark, ragged):
    assert same(spark, ragged, "flip_v") == 54 * 64


def test_height_counts_missing_pixels(spark, tmp_path):
    """A whole row that is missing counts as one."""
    pd.DataFrame({"vec_id": [0, 60], "label": [0, 1], "embedding": [[0.5] * 64] * 2}).to_parquet(tmp_path / "embeddings.parquet")
    assert model.height(spark, str(tmp_path)) == 3


@pytest.mark.parametrize("name", ("tiff_round_trip", "tiff_level"))
def test_tiff(spark, ragged, name):
    assert same(spark, ragged, name)


@pytest.mark.parametrize("dtype", ("float32", "float64"))
def test_tiff_gaps(spark, tmp_path, dtype):
    """Missing pixels stay missing, whole tiles of them too; NaN, infinities and zeros are values.  Without gaps they are 0."""
    rows = [(0, 0, 0, float("nan")), (1, 2, 0, float("inf")), (3, 39, 0, -0.5), (20, 5, 1, 0.0)]
    px = spark.createDataFrame([*rows, (2, 2, 1, None)], "y int, x int, channel_id int, value double")
    path = bigtiff.write_ome_tiff(px, f"{tmp_path}/{dtype}.tif", 40, 40, ["a", "b"], tile=16, dtype=dtype, gaps=True)
    assert sorted(map(str, tiff.read(spark, path)[0].collect())) == sorted(map(str, spark.createDataFrame(rows, px.schema).collect()))
    assert tiff.read(spark, path)[0].where("y = 2").count() == 0
    filled = bigtiff.write_ome_tiff(px, f"{tmp_path}/filled.tif", 40, 40, ["a", "b"], tile=16, dtype=dtype)
    assert tiff.read(spark, filled)[0].count() == 2 * 40 * 40
    with pytest.raises(ValueError, match="missing pixels"):
        bigtiff.write_ome_tiff(px, f"{tmp_path}/int.tif", 40, 40, ["a", "b"], tile=16, dtype="uint8", gaps=True)


def test_zarr_channels(spark, ragged):
    assert same(spark, ragged, "zarr_channels")


def test_zarr_gaps(spark, tmp_path):
    """As with TIFF, for the folder with and without its log."""
    rows = [(0, 0, 0, float("nan")), (1, 2, 0, float("inf")), (3, 39, 0, -0.5), (20, 5, 1, 0.0)]
    px = spark.createDataFrame([*rows, (2, 2, 1, None)], "y int, x int, channel_id int, value double")
    store = ZarrStore(spark, f"{tmp_path}/g.ome.zarr")
    store.create(40, 40, tile=16, gaps=True)
    store.append(px, ["a", "b"])
    want = sorted(map(str, spark.createDataFrame(rows, px.schema).collect()))
    assert sorted(map(str, zarr.read(spark, store.path)[0].collect())) == want
    (tmp_path / "g.ome.zarr" / "_commits").rename(tmp_path / "log")
    assert sorted(map(str, zarr.read(spark, store.path)[0].collect())) == want
    with pytest.raises(ValueError, match="missing pixels"):
        ZarrStore(spark, f"{tmp_path}/i.ome.zarr").create(40, 40, "|u1", gaps=True)


@pytest.fixture(scope="module")
def beyond(tmp_path_factory):
    """Shapes that reach beyond both sides of the image that they are rasterised in."""
    d = tmp_path_factory.mktemp("beyond")
    rng = np.random.default_rng(12)
    pd.DataFrame({"event_id": range(400), "user_id": rng.integers(0, 9, 400), "value": np.round(rng.uniform(-90, 900, 400), 2)}).to_parquet(d / "events.parquet")
    pd.DataFrame({"vec_id": [0], "label": [0], "embedding": [[0.5] * 64]}).to_parquet(d / "embeddings.parquet")
    return str(d)


def test_rasterise_binary(spark, beyond):
    assert same(spark, beyond, "rasterise_binary")


def test_rasterise_index(spark, beyond):
    assert same(spark, beyond, "rasterise_index")


def test_rasterise_table(spark, beyond):
    assert same(spark, beyond, "rasterise_table")


def test_xml_meta_is_dealt_out(spark):
    """Parsing takes long beside the few bytes of a table: tasks for all cores, and a parse for each field."""
    df = QUERIES["xml_meta"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and plan.count("xpath") == 3


def test_xml_fields(spark):
    """Empty values are there, missing ones are not; values that begin with the mark, and lines."""
    df = spark.createDataFrame([(1, "<a b=''><c>11x</c></a>"), (2, "<a><c>1\n1</c><c>z</c></a>"), (3, "<a b='1'><c/></a>"), (4, None)], "k int, t string")
    got = df.select("k", *xml.xml_fields(F.col("t"), {"b": "/a/@b", "c": "/a/c", "n": "count(/a/c)"})).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, "", "11x", "1"), (2, None, "1\n1", "2"), (3, "1", "", "1"), (4, None, None, None)]
