"""Command line: info, thumbnail, crop, mask, merge, combine, convert, transform, stitch."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from slidespark.functions.geometry import box_pixels
from slidespark.operators import pixels, vectors
from slidespark.plans.catalog import export_name
from slidespark.plans.levels import thumbnail, tiff_levels, tile_size
from slidespark.session import session
from slidespark.sinks import bigtiff, images, zarr_store
from slidespark.sinks.text import write_geojson
from slidespark.sources import read


def _size(ds) -> tuple[int, int]:
    r = ds.frame.agg(F.max("y"), F.max("x")).first()
    return r[0] + 1, r[1] + 1


def _save(frame, ds, height: int, width: int, out: str, as_uint8: bool, fmt: str) -> str:
    if as_uint8:
        frame = pixels.rescale_uint8(frame)
    if fmt == "ome-zarr":
        return zarr_store.write_zarr(frame, out + ".ome.zarr", height, width, ds.channels, ds.resolution, dtype="|u1" if as_uint8 else "<f4")
    tile = tile_size(height, width) or 256
    levels = len(tiff_levels(height, width, tile))
    return bigtiff.write_ome_tiff(frame, out + ".ome.tiff", height, width, ds.channels, ds.resolution, tile, levels, "uint8" if as_uint8 else "float32")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="slidespark")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("info", "thumbnail", "crop", "mask", "merge", "combine", "convert", "transform", "stitch"):
        c = sub.add_parser(name)
        c.add_argument("inputs", nargs="+")
        if name != "info":
            c.add_argument("-o", "--output", required=True)
            c.add_argument("--as-uint8", action="store_true")
            c.add_argument("--fmt", choices=("ome-tiff", "ome-zarr"), default="ome-tiff")
        if name in ("crop", "mask"):
            c.add_argument("--box", nargs=4, type=float, metavar=("LEFT", "RIGHT", "TOP", "BOTTOM"))
            c.add_argument("--polygon", help="JSON list of x, y pairs")
        if name == "combine":
            c.add_argument("--how", choices=("sum", "mean", "max"), default="max")
            c.add_argument("--match", action="store_true", help="give all images the histogram of the first")
        if name == "transform":
            c.add_argument("--matrix", required=True, help="JSON 3 x 3 for x, y")
        if name == "thumbnail":
            c.add_argument("--size", type=int, default=1024)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = session()
    sets = [read(spark, p) for p in a.inputs]
    if a.command == "info":
        for d in sets:
            print(json.dumps({"key": d.key, "kind": d.kind, "channels": d.channels, "resolution": d.resolution, "columns": d.frame.columns}))
        return 0
    out, first = Path(a.output), sets[0]
    if a.command == "transform":
        moved = vectors.warp_points(first.frame, tuple(map(tuple, json.loads(a.matrix))))
        if first.kind == "shapes":
            write_geojson(vectors.nested(moved), str(out))
        else:
            moved.write.mode("ignore").option("header", True).csv(str(out))
        return 0
    h, w = _size(first)
    stem = Path(a.inputs[0]).name.split(".")[0]
    if a.command == "thumbnail":
        th, tw, *_ = thumbnail(h, w, a.size)
        small = pixels.rescale_uint8(pixels.resize(first.frame, w, h, tw, th))
        array = images.to_array(small, th, tw, len(first.channels), 0.0)
        out.write_bytes(images.png(np.moveaxis(array, 0, 2) if len(first.channels) in (3, 4) else array[0]))
    elif a.command in ("crop", "mask"):
        if not a.box and not a.polygon:
            raise SystemExit("a box or a polygon is needed")
        if a.polygon:
            shape = [tuple(v) for v in json.loads(a.polygon)]
            frame = pixels.crop_polygon(first.frame, shape) if a.command == "crop" else pixels.mask(first.frame, pixels.in_shape(shape))
        else:
            left, right, top, bottom = box_pixels(*a.box)
            frame = pixels.crop(first.frame, left, right, top, bottom) if a.command == "crop" else pixels.mask(first.frame, pixels.in_box(left, right, top, bottom))
            h, w = (min(h, bottom) - max(top, 0), min(w, right) - max(left, 0)) if a.command == "crop" else (h, w)
            stem = export_name(stem, "crop", left=left, right=right, top=top, bottom=bottom) if a.command == "crop" else stem
        _save(frame, first, h, w, str(out / stem), a.as_uint8, a.fmt)
    elif a.command == "merge":
        frame = pixels.merge_channels([d.frame for d in sets], [len(d.channels) for d in sets])
        first.channels = [f"{c} - {d.key}" for d in sets for c in d.channels]
        _save(frame, first, h, w, str(out / export_name(stem, "merge")), a.as_uint8, a.fmt)
    elif a.command == "combine":
        frame = pixels.combine([d.frame for d in sets], a.how, a.match)
        _save(frame, first, h, w, str(out / f"{stem}-{a.how}"), a.as_uint8, a.fmt)
    elif a.command == "stitch":
        scenes = None
        for k, d in enumerate(sets):
            part = d.frame.withColumns({"scene_index": F.lit(k), "x0": F.lit(0), "y0": F.lit(0)})
            scenes = part if scenes is None else scenes.unionByName(part)
        _save(pixels.stitch(scenes), first, h, w, str(out / stem), a.as_uint8, a.fmt)
    else:
        _save(first.frame, first, h, w, str(out / stem), a.as_uint8, a.fmt)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
