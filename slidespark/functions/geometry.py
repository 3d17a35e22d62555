"""Matrices (row-major 3 x 3 tuples, acting on columns (x, y, 1)) and geometric predicates as expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Matrix = tuple[tuple[float, float, float], ...]
IDENTITY: Matrix = ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))


def compose(*matrices: Matrix) -> Matrix:
    """The product: the last one acts first."""
    out = matrices[0]
    for m in matrices[1:]:
        out = tuple(tuple(sum(out[i][k] * m[k][j] for k in range(3)) for j in range(3)) for i in range(3))
    return out


def invert(m: Matrix) -> Matrix:
    (a, b, c), (d, e, f), (g, h, i) = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    if not det:
        raise ValueError("the matrix has no inverse")
    cof = ((e * i - f * h, c * h - b * i, b * f - c * e), (f * g - d * i, a * i - c * g, c * d - a * f), (d * h - e * g, b * g - a * h, a * e - b * d))
    return tuple(tuple(v / det for v in row) for row in cof)


def translation(x: float, y: float) -> Matrix:
    return ((1.0, 0.0, x), (0.0, 1.0, y), (0.0, 0.0, 1.0))


def scaling(s: float) -> Matrix:
    return ((s, 0.0, 0.0), (0.0, s, 0.0), (0.0, 0.0, 1.0))


def centred_rotation(width: float, height: float, spacing: float, degrees: float) -> Matrix:
    """Rotation about the middle of an image."""
    r = math.radians(degrees)
    turn = ((math.cos(r), -math.sin(r), 0.0), (math.sin(r), math.cos(r), 0.0), (0.0, 0.0, 1.0))
    cx, cy = width * spacing / 2, height * spacing / 2
    return compose(translation(cx, cy), turn, translation(-cx, -cy))


def flip(width: int, height: int, horizontal: bool = False, vertical: bool = False) -> Matrix:
    """Mirror about the middle of the pixel grid."""
    return ((-1.0 if horizontal else 1.0, 0.0, width - 1.0 if horizontal else 0.0), (0.0, -1.0 if vertical else 1.0, height - 1.0 if vertical else 0.0), (0.0, 0.0, 1.0))


def rescale(m: Matrix, factor: float, with_translation: bool = True) -> Matrix:
    t = factor if with_translation else 1.0
    return ((m[0][0] * factor, m[0][1] * factor, m[0][2] * t), (m[1][0] * factor, m[1][1] * factor, m[1][2] * t), m[2])


def um_to_px(m: Matrix, moving_um: float, fixed_um: float) -> Matrix:
    """A physical matrix for pixels of the moving image to pixels of the fixed one."""
    return compose(scaling(1 / fixed_um), m, scaling(moving_um))


def swap_axes(m: Matrix) -> Matrix:
    """The matrix for (y, x) instead of (x, y), or back."""
    o = (1, 0, 2)
    return tuple(tuple(m[i][j] for j in o) for i in o)


def rotated_size(width: float, height: float, degrees: float) -> tuple[int, int]:
    """Width and height that hold the turned image."""
    s, c = abs(math.sin(math.radians(degrees))), abs(math.cos(math.radians(degrees)))
    return math.ceil(round(height * s + width * c, 9)), math.ceil(round(height * c + width * s, 9))


def affine_bounds(m: Matrix, width: float, height: float, spacing: float = 1.0) -> tuple[int, int]:
    """Size that holds the corners moved by the matrix, and its translation."""
    at = [(m[0][0] * x + m[0][1] * y, m[1][0] * x + m[1][1] * y) for x in (0, width) for y in (0, height)]
    return tuple(math.ceil(max(p[k] for p in at) - min(p[k] for p in at) + abs(m[k][2]) / spacing) for k in (0, 1))


def is_identity(m: Matrix, tolerance: float = 1e-8) -> bool:
    return all(abs(m[i][j] - IDENTITY[i][j]) <= tolerance for i in range(3) for j in range(3))


def matrix_key(yx: bool = True, px: bool = True, inverse: bool = False) -> str:
    """Name of a matrix in a registration file."""
    return f"matrix_{'yx' if yx else 'xy'}_{'px' if px else 'um'}{'_inv' * inverse}"


def moved(m: Matrix, x: Column, y: Column) -> tuple[Column, Column]:
    """The point (x, y) moved by the matrix."""
    u, v, w = (F.lit(r[0]) * x + F.lit(r[1]) * y + F.lit(r[2]) for r in m)
    return u / w, v / w


def in_polygon(polygon: Sequence[tuple[float, float]], x: Column, y: Column) -> Column:
    """Whether (x, y) is inside, by the number of edges that a ray to the right crosses: edges as one expression, no join."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(polygon, [*polygon[1:], polygon[0]], strict=True):
        if y1 != y2:
            at = F.lit(float(x2 - x1)) * (y - F.lit(float(y1))) / F.lit(float(y2 - y1)) + F.lit(float(x1))
            crossings = crossings + F.when(((F.lit(float(y1)) > y) != (F.lit(float(y2)) > y)) & (x < at), 1).otherwise(0)
    return crossings % 2 == 1


def polygon_box(polygon: Sequence[tuple[float, float]]) -> tuple[float, float, float, float]:
    """left, right, top, bottom."""
    xs, ys = zip(*polygon, strict=True)
    return min(xs), max(xs), min(ys), max(ys)


def box_pixels(left: float, right: float, top: float, bottom: float, resolution: float | None = None) -> tuple[int, int, int, int]:
    """A half-open pixel box: ends in order, lower ones down, upper ones up; in micrometres if there is a resolution."""
    k = 1 / resolution if resolution else 1.0
    (a, b), (c, d) = sorted((left, right)), sorted((top, bottom))
    return math.floor(a * k), math.ceil(b * k), math.floor(c * k), math.ceil(d * k)


def clamp_box(x: int, y: int, width: int, height: int, image_width: int, image_height: int) -> tuple[int, int, int, int]:
    """A box for a writer: negative origins become 0 without making it smaller, the far ends are cut at the image."""
    x, y = max(x, 0), max(y, 0)
    return x, y, min(width, image_width - x), min(height, image_height - y)


def simple_polygon(polygon: Sequence[tuple[float, float]]) -> bool:
    """At least three vertices, an area, and no edges that cross."""
    ring = list(dict.fromkeys(polygon))
    n = len(ring)
    if n < 3 or not area(ring):
        return False

    def turn(a, b, c) -> int:
        v = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
        return (v > 0) - (v < 0)

    for i in range(n):
        for j in range(i + 2, n):
            if (i, j) != (0, n - 1):
                a, b, c, d = ring[i], ring[i + 1], ring[j], ring[(j + 1) % n]
                if turn(a, b, c) * turn(a, b, d) <= 0 and turn(c, d, a) * turn(c, d, b) <= 0:
                    return False
    return True


def area(polygon: Sequence[tuple[float, float]]) -> float:
    return abs(sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(polygon, [*polygon[1:], polygon[0]], strict=True))) / 2


def rotated_size_of(width: Column, height: Column, degrees: Column) -> tuple[Column, Column]:
    """Width and height that hold a turned image, as rotated_size, for columns."""
    s, c = F.abs(F.sin(F.radians(degrees))), F.abs(F.cos(F.radians(degrees)))
    return F.ceil(F.round(height * s + width * c, 9)).cast("int"), F.ceil(F.round(height * c + width * s, 9)).cast("int")


def centred_rotation_of(width: Column, height: Column, spacing: Column, degrees: Column) -> dict[str, Column]:
    """The rows m00 .. m12 of a rotation about the middle of an image, as centred_rotation, for columns."""
    s, c, cx, cy = F.sin(F.radians(degrees)), F.cos(F.radians(degrees)), width * spacing / 2, height * spacing / 2
    return {"m00": c, "m01": -s, "m02": cx - cx * c + cy * s, "m10": s, "m11": c, "m12": cy - cx * s - cy * c}
