"""Registered queries that write files from the tables at hand and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from slidespark.plans import model
from slidespark.plans.queries import query, with_px
from slidespark.sinks import bigtiff
from slidespark.sinks.zarr_store import ZarrStore
from slidespark.sources import imzml, tiff, zarr
from slidespark.storage import scratch

#: Sides of the tiles of the written images: smaller than the image, so that a crop has tiles to leave out.
TILE = 16
NAMES = [f"m/z {k}" for k in range(model.CHANNELS)]
BOX = "y >= 3 AND y < 12 AND x >= 17 AND x < 24 AND channel_id IN (5, 33, 60)"


def image(spark, d, levels: int = 1) -> str:
    """The embeddings as an OME-TIFF of 64 channels; the last row of pixels need not be full."""
    path = f"{scratch(spark, 'tiff')}/image.ome.tiff".removeprefix("file://").removeprefix("file:")
    return bigtiff.write_ome_tiff(model.px(spark, d), path, model.height(spark, d), model.WIDTH, NAMES, 0.5, TILE, levels, gaps=True)


@query(with_px("SELECT y, x, channel_id, value FROM px"))
def tiff_round_trip(spark, d):
    """Written by tasks, read by tiles."""
    return tiff.read(spark, image(spark, d))[0]


@query(
    with_px(
        "SELECT CAST(y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x, channel_id, CAST(CAST(avg(value) AS FLOAT) AS DOUBLE) AS value "
        "FROM px, (SELECT (max(vec_id) // 25 + 1) // 2 * 2 AS h FROM embeddings) WHERE x < 24 AND y < h GROUP BY 1, 2, 3"
    )
)
def tiff_level(spark, d):
    """The second level of a written pyramid."""
    return tiff.read(spark, image(spark, d, 2), 1)[0]


@query(with_px(f"SELECT y, x, channel_id, value FROM px WHERE {BOX}"))
def tiff_crop(spark, d):
    """Some channels of a box: only the tiles that it touches are read."""
    return tiff.read(spark, image(spark, d))[0].where(BOX)


@query(with_px(f"SELECT channel_id, count(DISTINCT y // {TILE} * 100 + x // {TILE}) AS tiles, true AS fewer_bytes FROM px WHERE {BOX} GROUP BY channel_id"))
def tiff_tiles(spark, d):
    """How many tiles the crop reads of each channel, by the offsets of the tiles that its pixels came from, and that they are
    fewer bytes than the tiles of the whole channel."""
    px = tiff.read(spark, image(spark, d), tiles=True)[0]

    def bytes_of(frame, name):
        once = frame.select("channel_id", "tile", "tile_bytes").distinct()
        return once.groupBy("channel_id").agg(F.count(F.lit(1)).alias(name), F.sum("tile_bytes").alias(f"{name}_bytes"))

    read, whole = bytes_of(px.where(BOX), "tiles"), bytes_of(px, "whole")
    return read.join(whole, "channel_id").select("channel_id", "tiles", (F.col("tiles_bytes") < F.col("whole_bytes")).alias("fewer_bytes"))


@query(with_px("SELECT y, x, channel_id, value FROM px"))
def zarr_channels(spark, d):
    """The channels of an OME-Zarr folder that were appended in three goes, one of them twice."""
    px = model.px(spark, d)
    store = ZarrStore(spark, f"{scratch(spark, 'zarr')}/image.ome.zarr")
    store.create(model.height(spark, d), model.WIDTH, tile=TILE, gaps=True)
    for first, last in ((0, 40), (40, 63), (40, 63), (63, 64)):
        part = px.where((F.col("channel_id") >= first) & (F.col("channel_id") < last)).withColumn("channel_id", F.col("channel_id") - first)
        store.append(part, NAMES[first:last], f"from {first}")
    return zarr.read(spark, store.path)[0]


_ION_TARGETS = (1001.5, 20000.0, 35000.25, 50000.0)
_ION_SQL = " UNION ALL ".join(f"SELECT {k} AS k, {t}::DOUBLE AS t" for k, t in enumerate(_ION_TARGETS))


def _centroids(spark, d) -> str:
    """Order lines as peaks of an image, in a store of m/z ranges."""
    path = f"{scratch(spark, 'centroids')}/store"
    peaks = model.load(spark, d, "lineitem").select(F.floor(F.col("l_orderkey") / 100).cast("int").alias("y"), (F.col("l_orderkey") % 100).cast("int").alias("x"), F.col("l_extendedprice").alias("mz"), F.col("l_quantity").alias("intensity"))
    imzml.write_centroids(peaks, path, 32)
    return path


@query(
    f"WITH v AS ({_ION_SQL}) SELECT CAST(l_orderkey // 100 AS INTEGER) AS y, CAST(l_orderkey % 100 AS INTEGER) AS x, CAST(k AS INTEGER) AS channel_id, sum(l_quantity) AS value "
    "FROM lineitem JOIN v ON l_extendedprice >= t - t * 500 * 1e-6::DOUBLE AND l_extendedprice <= t + t * 500 * 1e-6::DOUBLE GROUP BY 1, 2, 3"
)
def centroid_images(spark, d):
    """Ion images from a store of centroids, of which only the files of the targets are opened."""
    return imzml.centroid_images(spark, _centroids(spark, d), _ION_TARGETS, 500.0)


@query("SELECT count(*) AS peaks, true AS few_files, true AS all_found FROM lineitem WHERE l_extendedprice BETWEEN 34990 AND 35010")
def centroid_files(spark, d):
    """How many peaks one window has, and that they are in a quarter of the files at most, which hold all of them."""
    path, at, ppm = _centroids(spark, d), 35000.0, 10 / 35000 * 1e6
    found, every = imzml.centroid_files(spark, path, [at], ppm), spark.read.parquet(f"{path}/peaks")
    inside = "mz BETWEEN 34990 AND 35010"
    whole = every.where(inside).agg(F.count(F.lit(1)).alias("n"))
    few = F.lit(4 * len(found) <= every.select(F.input_file_name()).distinct().count())
    return spark.read.parquet(*found).where(inside).agg(F.count(F.lit(1)).alias("peaks")).join(F.broadcast(whole)).select("peaks", few.alias("few_files"), (F.col("n") == F.col("peaks")).alias("all_found"))
