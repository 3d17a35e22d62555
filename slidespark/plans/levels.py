"""Pyramid planning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tile_size(height: int, width: int, tile: int = 1024, least: int = 256) -> int:
    """Halve the tile until the image has two of them each way; 0 (untiled) for an image smaller than the least tile."""
    while tile > least and (height / tile <= 1 or width / tile <= 1):
        tile //= 2
    tile = max(tile, least)
    return 0 if height < tile or width < tile else tile


def tiff_levels(height: int, width: int, tile: int) -> list[tuple[int, int]]:
    """Sizes of the levels: halved while all sides exceed the tile, without the last."""
    if not tile:
        return [(height, width)]
    out = [(height, width)]
    while min(out[-1]) > tile:
        out.append((out[-1][0] // 2, out[-1][1] // 2))
    return out[:-1] if len(out) > 1 else out


def zarr_levels(height: int, width: int, tile: int) -> list[tuple[int, int]]:
    """Halved as long as the shorter side is a tile at least."""
    k = 0
    while min(height, width) // 2 ** (k + 1) >= tile:
        k += 1
    return [(max(1, height // 2**i), max(1, width // 2**i)) for i in range(k + 1)]


def mean_levels(height: int, width: int, least: int = 1024) -> list[tuple[int, int]]:
    """Block-mean levels below the base."""
    ds = 1
    while min(height, width) // 2**ds >= least:
        ds += 1
    return [(height // 2**k, width // 2**k) for k in range(ds)]


def sort_levels(shapes: Sequence[tuple[int, int]]) -> list[int]:
    """Numbers of levels, the largest first, as they come among equals."""
    return sorted(range(len(shapes)), key=lambda k: -shapes[k][0] * shapes[k][1])


def pick_level(shapes: Sequence[tuple[int, int]], least: int = 1024, most: int = 2024) -> int:
    """The level whose longer side is nearest to `least` among those below `most`; -1 without one."""
    fit = [(abs(max(s) - least), k) for k, s in enumerate(shapes) if max(s) < most]
    return min(fit)[1] if fit else -1


def level_scale(resolution: float, base: tuple[int, int], level: tuple[int, int]) -> float:
    return resolution * (base[0] / level[0] + base[1] / level[1]) / 2


def thumbnail(height: int, width: int, most: int = 2048) -> tuple[int, int, float, float]:
    """Height, width and scales of a thumbnail."""
    if max(height, width) <= most:
        return height, width, 1.0, 1.0
    f = most / max(height, width)
    h, w = int(height * f), int(width * f)
    return h, w, height / h, width / w


def tiles(height: int, width: int, tile: int) -> list[tuple[int, int, int, int]]:
    """y, x, height, width of tiles, row by row."""
    return [(y, x, min(tile, height - y), min(tile, width - x)) for y in range(0, height, tile) for x in range(0, width, tile)]


def image_size(shape: Sequence[int]) -> tuple[int, int | None, tuple[int, int]]:
    """Number of channels, channel axis and (height, width) of an array shape."""
    if len(shape) == 2:
        return 1, None, (shape[0], shape[1])
    if len(shape) != 3:
        raise ValueError(f"no image has the shape {tuple(shape)}")
    return (shape[2], 2, (shape[0], shape[1])) if shape[2] in (3, 4) else (shape[0], 0, (shape[1], shape[2]))


# the same for tables of images (height and width, as columns of that name) and of their levels


def level_table(images: DataFrame, tile: int, kind: str = "zarr") -> DataFrame:
    """images with a row for each level, its number and its size (level, h, w): halved as long as the shorter side is a tile at
    least (zarr) or more than a tile (tiff)."""
    shorter = F.least("height", "width")
    levels = F.filter(F.sequence(F.lit(0), F.lit(30)), lambda k: (k == 0) | (F.call_function("shiftright", shorter, k) >= tile + (kind == "tiff")))
    each = images.withColumn("level", F.explode(levels))
    return each.withColumns({n: F.call_function("shiftright", F.col(c), F.col("level")) for n, c in (("h", "height"), ("w", "width"))})


def rank_levels(table: DataFrame, by: str, number: str) -> DataFrame:
    """table with the rank (from 0) of each level (h, w) of an image: the largest first, as numbered among equals."""
    from pyspark.sql.window import Window

    order = Window.partitionBy(by).orderBy(F.desc(F.col("h").cast("long") * F.col("w")), number)
    return table.withColumn("rank", (F.row_number().over(order) - 1).cast("int"))


def pick_levels(table: DataFrame, by: str, number: str, least: int = 1024, most: int = 2024) -> DataFrame:
    """by and the number of the level whose longer side is nearest to `least` among those below `most`; -1 without one."""
    side = F.greatest("h", "w")
    fit = F.when(side < most, F.struct(F.abs(side - least), F.col(number)))
    return table.groupBy(by).agg(F.coalesce(F.min(fit)[number], F.lit(-1)).alias("level"))
