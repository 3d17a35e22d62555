"""Scalar functions of the engine as Column expressions: names, labels, units, sizes and types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions that a dataset's display name loses, longest forms first.
NAME_EXTENSIONS = (".ome.tiff", ".ome.tif", ".ome.zarr", ".qptiff", ".tiff", ".tif", ".czi", ".svs", ".ndpi", ".scn", ".png", ".jpeg", ".jpg", ".imzml", ".h5")
#: Micrometres per unit of a TIFF resolution unit tag (1 none, 2 inch, 3 centimetre).
TIFF_UNITS = {1: 1.0, 2: 25400.0, 3: 10000.0}
#: Micrometres per length unit.
LENGTH_UNITS = {"m": 1e6, "cm": 1e4, "mm": 1e3, "um": 1.0, "µm": 1.0, "nm": 1e-3, "pm": 1e-6}
#: Weights of R, G, B in grey, each product truncated.
GREY = (0.2125, 0.7154, 0.0721)
UNNAMED = "unnamed"


def mz_label(mz: Column) -> Column:
    """m/z with three decimals."""
    return F.format_string("m/z %.3f", mz.cast("double"))


def clean_name(name: Column) -> Column:
    """The name without any occurrence of the known extensions, removed one after the other."""
    for ext in NAME_EXTENSIONS:
        name = F.replace(name, F.lit(ext), F.lit(""))
    return name


def grey(r: Column, g: Column, b: Column) -> Column:
    """Grey of 8-bit channels: the sum of three truncated products, in 8 bits."""
    parts = [F.floor(c.cast("double") * F.lit(w)) for c, w in zip((r, g, b), GREY, strict=True)]
    return ((parts[0] + parts[1] + parts[2]) % F.lit(256)).cast("int")


def integer_type(largest: Column) -> Column:
    """The narrowest type that holds the value, as a name; null beyond unsigned 32 bits."""
    return F.when(largest <= 255, "uint8").when(largest <= 65535, "uint16").when(largest <= 4294967295, "int32")


def tiff_resolution(numerator: Column, denominator: Column, unit: Column) -> Column:
    """Micrometres per pixel of a TIFF resolution tag; null for an unknown unit."""
    scale = F.when(unit == 1, TIFF_UNITS[1]).when(unit == 2, TIFF_UNITS[2]).when(unit == 3, TIFF_UNITS[3])
    return denominator.cast("double") / numerator.cast("double") * scale


def length_um(value: Column, unit: Column) -> Column:
    factor = None
    for name, scale in LENGTH_UNITS.items():
        factor = F.when(unit == name, scale) if factor is None else factor.when(unit == name, scale)
    return value.cast("double") * factor


def svs_resolution(description: Column) -> Column:
    """The MPP entry of a bar-separated description; 1.0 without one."""
    return F.coalesce(F.regexp_extract(description, r"(?:^|\|)[^|=]*MPP[^|=]*=\s*([0-9.eE+-]+)", 1).try_cast("double"), F.lit(1.0))


def biomarker_name(biomarker: Column, name: Column, number: Column) -> Column:
    """'Biomarker - Name (Ci)' from the parts that are there."""
    label = F.concat_ws(" - ", F.when(biomarker != "", biomarker), F.when(name != "", name))
    return F.concat(label, F.when(label != "", F.lit(" ")).otherwise(""), F.lit("(C"), number.cast("string"), F.lit(")"))


def named(name: Column) -> Column:
    """The name, or the default one."""
    return F.coalesce(F.when(name != "", name), F.lit(UNNAMED))


def point_size(n: Column, from_shapes: bool) -> Column:
    """Display size of points by their number."""
    return F.when(n > 50_000, 1).when(n > 5_000, 5).otherwise(15) if from_shapes else F.when(n < 50_000, 5).otherwise(1)


def edge_width(n: Column) -> Column:
    return F.when(n < 500, 10).otherwise(3)


def region_hash(text: Column) -> Column:
    """Four characters that name a region."""
    return F.substring(F.sha1(text.cast("binary")), 1, 4)


def is_rgb(n_dims: Column, last: Column) -> Column:
    return (n_dims > 2) & (last < 5)


def channel_axis(n_dims: Column, last: Column) -> Column:
    """-1 for none, 2 for channels last (three or four of them), else 0; null beyond three dimensions."""
    return F.when(n_dims == 2, -1).when((n_dims == 3) & last.isin(3, 4), 2).when(n_dims == 3, 0)


def n_channels(first: Column, n_dims: Column, last: Column) -> Column:
    axis = channel_axis(n_dims, last)
    return F.when(axis == -1, 1).when(axis == 2, last).when(axis == 0, first)


def clip_side(side: Column, other: Column, most: int) -> Column:
    """The side of a size capped to `most`, in proportion."""
    largest = F.greatest(side, other)
    return F.when(largest > most, F.floor(side.cast("double") * (F.lit(float(most)) / largest))).otherwise(side).cast("int")
