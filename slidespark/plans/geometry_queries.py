"""Registered queries of transforms that are fitted to point pairs, and of displacement fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from slidespark.operators import fields, fits
from slidespark.plans import model
from slidespark.plans.queries import query

# five groups of pairs from events; the first two kinds have noise, the others are exact
_M = "SELECT event_id % 5 AS g, value AS mx, CAST(event_id % 97 AS DOUBLE) AS my, event_id FROM events"
_NOISY = f"""
p AS (SELECT g, mx, my, (1 + g * 0.2::DOUBLE) * mx - 0.3::DOUBLE * my + 5 + event_id % 7 AS fx, 0.3::DOUBLE * mx + (1 + g * 0.2::DOUBLE) * my - g + event_id % 11 AS fy FROM ({_M})),
s AS (SELECT g, count(*) AS n, covar_pop(mx, fx) + covar_pop(my, fy) AS re, covar_pop(mx, fy) - covar_pop(my, fx) AS im, var_pop(mx) + var_pop(my) AS size,
             avg(mx) AS ax, avg(my) AS ay, avg(fx) AS bx, avg(fy) AS by_ FROM p GROUP BY g)"""


def _turned(size: str) -> str:
    return (
        f"WITH {_NOISY}, z AS (SELECT *, re / {size} AS c, im / {size} AS k FROM s) "
        "SELECT g, n, round(c, 6) AS m00, round(-k, 6) AS m01, round(bx - c * ax + k * ay, 6) AS m02, round(k, 6) AS m10, round(c, 6) AS m11, round(by_ - k * ax - c * ay, 6) AS m12 FROM z"
    )


def _pairs(spark, d, x, y):
    e = model.load(spark, d, "events").select((F.col("event_id") % 5).alias("g"), F.col("value").alias("mx"), (F.col("event_id") % 97).cast("double").alias("my"), "event_id")
    return e.select("g", "mx", "my", x.alias("fx"), y.alias("fy"))


def _noisy(spark, d):
    a = 1 + F.col("g") * 0.2
    return _pairs(spark, d, a * F.col("mx") - 0.3 * F.col("my") + 5 + F.col("event_id") % 7, 0.3 * F.col("mx") + a * F.col("my") - F.col("g") + F.col("event_id") % 11)


def _rounded(df, names):
    return df.select("g", "n", *(F.round(c, 6).alias(c) for c in names))


@query(_turned("size"))
def similarity_fit(spark, d):
    """Turn, scale and shift of each group."""
    return _rounded(fits.fit(_noisy(spark, d), "similarity", "g"), fits.MATRIX[:6])


@query(_turned("sqrt(re * re + im * im)"))
def euclidean_fit(spark, d):
    """Turn and shift of each group."""
    return _rounded(fits.fit(_noisy(spark, d), "euclidean", "g"), fits.MATRIX[:6])


@query("SELECT event_id % 5 AS g, count(*) AS n, 1.1::DOUBLE AS m00, 0.2::DOUBLE AS m01, 3.0::DOUBLE AS m02, -0.1::DOUBLE AS m10, 0.9::DOUBLE AS m11, CAST(g AS DOUBLE) AS m12, 0.001::DOUBLE * (g + 1) AS m20, 0.002::DOUBLE AS m21, 1.0::DOUBLE AS m22 FROM events GROUP BY 1")
def projective_fit(spark, d):
    """The homography that each group was made with."""
    w = 0.001 * (F.col("g") + 1) * F.col("mx") + 0.002 * F.col("my") + 1
    pairs = _pairs(spark, d, (1.1 * F.col("mx") + 0.2 * F.col("my") + 3) / w, (-0.1 * F.col("mx") + 0.9 * F.col("my") + F.col("g")) / w)
    return _rounded(fits.fit(pairs, "projective", "g"), fits.MATRIX)


@query(
    "SELECT event_id % 5 AS g, count(*) AS n, 2.0::DOUBLE AS x0, 1.0::DOUBLE AS x1, -0.25::DOUBLE AS x2, 0.01::DOUBLE AS x3, 0.02::DOUBLE AS x4, CAST(g AS DOUBLE) / 100 AS x5, "
    "-7.0::DOUBLE AS y0, 0.5::DOUBLE AS y1, 1.5::DOUBLE AS y2, 0.0::DOUBLE AS y3, -0.01::DOUBLE AS y4, 0.03::DOUBLE AS y5 FROM events GROUP BY 1"
)
def polynomial_fit(spark, d):
    """The polynomial of the second order that each group was made with."""
    x, y = F.col("mx"), F.col("my")
    pairs = _pairs(spark, d, 2 + x - 0.25 * y + 0.01 * x * x + 0.02 * x * y + F.col("g") / 100 * y * y, -7 + 0.5 * x + 1.5 * y - 0.01 * x * y + 0.03 * y * y)
    out = _rounded(fits.fit(pairs, "polynomial", "g"), fits.COEFFICIENTS)
    return out.withColumns({c: F.col(c) + 0.0 for c in fits.COEFFICIENTS})  # no negative zero


# a field with a node for each customer, twelve in a row, ten apart
ACROSS, STEP = 12, 10.0
_FIELD = f"""
n AS (SELECT c_custkey // {ACROSS} AS gy, c_custkey % {ACROSS} AS gx, c_acctbal / 5000 AS dy, (c_acctbal - 4000) / 6000 AS dx FROM customer),
c AS (SELECT a.gy, a.gx, a.dy AS dy00, a.dx AS dx00, b.dy AS dy01, b.dx AS dx01, e.dy AS dy10, e.dx AS dx10, f.dy AS dy11, f.dx AS dx11 FROM n a JOIN n b ON b.gy = a.gy AND b.gx = a.gx + 1
      JOIN n e ON e.gy = a.gy + 1 AND e.gx = a.gx JOIN n f ON f.gy = a.gy + 1 AND f.gx = a.gx + 1),
z AS (SELECT max(gy) + 1 AS h, max(gx) + 1 AS w FROM c),
p AS (SELECT event_id, value AS x, CAST(event_id % 101 AS DOUBLE) AS y, least(greatest(value / {STEP}, 0), w) AS u, least(event_id % 101 / {STEP}, h) AS v, h, w FROM events, z),
q AS (SELECT *, CAST(least(floor(u), w - 1) AS INTEGER) AS cx, CAST(least(floor(v), h - 1) AS INTEGER) AS cy FROM p),
m AS (SELECT event_id, x, y, (dx00 * (1 - (u - cx)) + dx01 * (u - cx)) * (1 - (v - cy)) + (dx10 * (1 - (u - cx)) + dx11 * (u - cx)) * (v - cy) AS dx,
             (dy00 * (1 - (u - cx)) + dy01 * (u - cx)) * (1 - (v - cy)) + (dy10 * (1 - (u - cx)) + dy11 * (u - cx)) * (v - cy) AS dy FROM q LEFT JOIN c ON c.gy = q.cy AND c.gx = q.cx)"""


def _field(spark, d):
    k = F.col("c_custkey")
    n = model.load(spark, d, "customer").select(F.floor(k / ACROSS).cast("int").alias("gy"), (k % ACROSS).cast("int").alias("gx"), (F.col("c_acctbal") / 5000).alias("dy"), ((F.col("c_acctbal") - 4000) / 6000).alias("dx"))
    return fields.field(n, STEP)


def _points(spark, d):
    return model.load(spark, d, "events").select("event_id", F.col("value").alias("x"), (F.col("event_id") % 101).cast("double").alias("y"))


@query(f"WITH {_FIELD} SELECT event_id, round(x + coalesce(dx, 0), 6) AS x, round(y + coalesce(dy, 0), 6) AS y FROM m")
def field_move(spark, d):
    """Events as points, moved by a displacement field."""
    return fields.move(_points(spark, d), _field(spark, d)).select("event_id", *(F.round(c, 6).alias(c) for c in ("x", "y")))


@query("SELECT event_id, round(value, 4) + 0 AS x, round(CAST(event_id % 101 AS DOUBLE), 4) AS y FROM events")
def field_there_and_back(spark, d):
    """Moved by the field and back by its inverse: every point is where it was, to within a ten-thousandth."""
    f = _field(spark, d)
    return fields.move_back(fields.move(_points(spark, d), f), f).select("event_id", *((F.round(c, 4) + 0.0).alias(c) for c in ("x", "y")))
