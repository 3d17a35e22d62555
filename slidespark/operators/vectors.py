"""Shapes and points: tables of vertices (shape_idx, shape_name, shape_type, i, x, y) and of points (x, y, features)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slidespark.functions.geometry import Matrix, matrix_key, moved
from slidespark.functions.scalars import named

#: Column names that hold what is wanted, the first one there wins.
X_NAMES, Y_NAMES = ("x", "x_location", "x_centroid", "x:x"), ("y", "y_location", "y_centroid", "y:y")
VERTEX_X, VERTEX_Y = ("vertex_x", "x"), ("vertex_y", "y")
GROUPS = ("cell", "cell_id", "shape", "shape_name")
FEATURES = ("feature_name", "name")


def first_column(df: DataFrame, names: Sequence[str]) -> str | None:
    return next((n for n in names if n in df.columns), None)


def has_columns(df: DataFrame, required: Sequence[str] = (), any_of: Sequence[Sequence[str]] = (), types: Sequence[str] | None = None) -> bool:
    """All required columns, one of each group, and, if given, only columns of these types among the required."""
    kinds = dict(df.dtypes)
    return all(c in kinds for c in required) and all(any(c in kinds for c in g) for g in any_of) and (types is None or all(kinds[c] in types for c in required))


def points(df: DataFrame) -> DataFrame:
    """x, y as doubles, then every other column as a feature."""
    x, y = first_column(df, X_NAMES), first_column(df, Y_NAMES)
    if x is None or y is None:
        raise ValueError(f"no point columns among {df.columns}")
    return df.select(F.col(f"`{x}`").cast("double").alias("x"), F.col(f"`{y}`").cast("double").alias("y"), *(c for c in df.columns if c not in (x, y)))


def feature_names(df: DataFrame) -> DataFrame:
    """Distinct values of the feature column, or else the names of all columns."""
    own = first_column(df, FEATURES)
    if own is None:
        return df.sparkSession.createDataFrame([(c,) for c in df.columns], "name string")
    return df.select(F.col(own).cast("string").alias("name")).distinct()


def numbered_by(df: DataFrame, key: str, name: str, parts: int | None = None) -> DataFrame:
    """df without key, and `name` counting its rows in the order of key: ranges of the key are sorted side by side, and each
    range's first number is the count of those before it."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # edges are keys of a sample of 16 rows a range
    edges = [r[key] for r in df.select(key).orderBy(F.xxhash64(key)).limit(16 * n).orderBy(key).collect()][15::16]
    part = sum((F.when(F.col(key) >= F.lit(e) if not hasattr(e, "asDict") else F.col(key) >= F.struct(*(F.lit(v).alias(c) for c, v in e.asDict().items())), 1).otherwise(0) for e in edges), F.lit(0))
    dealt = df.withColumn("_part", part)
    sizes = {r["_part"]: r["n"] for r in dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, first = 0, []
    for k in range(len(edges) + 1):
        first.append(before)
        before += sizes.get(k, 0)
    at = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1 + F.get(F.array(*(F.lit(v) for v in first)), F.col("_part"))
    return dealt.withColumn(name, at.cast("int")).drop("_part", key)


def vertices(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Vertices of shapes grouped by a name column: shape_idx counts names in the order of their first vertex."""
    x, y, group = first_column(df, VERTEX_X), first_column(df, VERTEX_Y), first_column(df, GROUPS)
    if None in (x, y, group):
        raise ValueError(f"no shape columns among {df.columns}")
    at = F.struct(*order)
    names = df.groupBy(F.col(group).cast("string").alias("shape_name")).agg(F.min(at).alias("_first"))
    numbered = numbered_by(names, "_first", "shape_idx")
    rows = df.select(F.col(group).cast("string").alias("shape_name"), F.col(x).cast("float").alias("x"), F.col(y).cast("float").alias("y"), at.alias("_at"))
    within = Window.partitionBy("shape_name").orderBy("_at")
    kind = "points" if x == "x" else "polygon"
    return rows.join(numbered, "shape_name").select("shape_idx", "shape_name", F.lit(kind).alias("shape_type"), (F.row_number().over(within) - 1).cast("int").alias("i"), "x", "y")


def shape_table(v: DataFrame) -> DataFrame:
    """x, y and shape = name-index of every vertex."""
    return v.select("x", "y", F.concat(named(F.col("shape_name")), F.lit("-"), F.col("shape_idx").cast("string")).alias("shape"))


def nested(v: DataFrame) -> DataFrame:
    """One row per shape with its vertices in order."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("i", "x", "y"))), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y")))
    return v.groupBy("shape_idx", "shape_name", "shape_type").agg(rows.alias("vertices"))


def swap_axes(v: DataFrame) -> DataFrame:
    return v.withColumns({"x": F.col("y"), "y": F.col("x")})


def scale(v: DataFrame, factor: float) -> DataFrame:
    return v.withColumns({"x": F.col("x") * factor, "y": F.col("y") * factor})


def warp_points(df: DataFrame, matrix: Matrix, x: str = "x", y: str = "y") -> DataFrame:
    """Points moved by a matrix."""
    u, v = moved(matrix, F.col(x).cast("double"), F.col(y).cast("double"))
    return df.withColumns({x: u, y: v})


def subsample(df: DataFrame, key: Column, ratio: float = 0.01, trigger: int = 1_000_000) -> DataFrame:
    """About ratio of the rows if there are more than trigger, chosen by a hash of the key: the same rows every time."""
    if df.limit(trigger + 1).count() <= trigger:
        return df
    return df.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(ratio * 1_000_000))


def polygon_areas(v: DataFrame) -> DataFrame:
    """shape_idx, n_vertices, area (shoelace) and whether it is a polygon at all."""
    ring = Window.partitionBy("shape_idx").orderBy("i")
    every = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    e = v.select("shape_idx", x.alias("x"), y.alias("y"), F.coalesce(F.lead(x).over(ring), F.first(x).over(every)).alias("x2"), F.coalesce(F.lead(y).over(ring), F.first(y).over(every)).alias("y2"))
    out = e.groupBy("shape_idx").agg(F.count(F.lit(1)).alias("n_vertices"), (F.abs(F.sum(F.col("x") * F.col("y2") - F.col("x2") * F.col("y"))) / 2).alias("area"))
    return out.withColumn("valid", (F.col("n_vertices") >= 3) & (F.col("area") > 0))


def fit_affine(pairs: DataFrame, *by: str) -> DataFrame:
    """Least-squares affine of point pairs (mx, my to fx, fy), one row m00 .. m12 for each group, from one aggregation.

    Covariances are built-in partial aggregates, so the normal equations stay small and well conditioned.
    """
    moments = {"uu": F.var_pop("mx"), "vv": F.var_pop("my"), "uv": F.covar_pop("mx", "my")}
    moments |= {c + f: F.covar_pop(m, f) for c, m in (("u", "mx"), ("v", "my")) for f in ("fx", "fy")} | {"a" + c: F.avg(c) for c in ("mx", "my", "fx", "fy")}
    s = pairs.groupBy(*by).agg(*(v.alias(k) for k, v in moments.items()))
    det = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
    out = {}
    for k, f in enumerate(("fx", "fy")):
        out[f"m{k}0"] = (F.col("u" + f) * F.col("vv") - F.col("v" + f) * F.col("uv")) / det
        out[f"m{k}1"] = (F.col("v" + f) * F.col("uu") - F.col("u" + f) * F.col("uv")) / det
    s = s.withColumns(out)
    return s.withColumns({f"m{k}2": F.col("a" + f) - F.col(f"m{k}0") * F.col("amx") - F.col(f"m{k}1") * F.col("amy") for k, f in enumerate(("fx", "fy"))}).select(*by, *(f"m{i}{j}" for i in (0, 1) for j in (0, 1, 2)))


def registration_matrices(landmarks: DataFrame, *by: str) -> DataFrame:
    """The affine matrices of registrations in all eight forms, named by `matrix_key`: axes yx or xy, pixels or micrometres, and
    the inverse (from fixed to moving).

    landmarks has a row per pair: fixed_y, fixed_x, moving_y, moving_x in pixels, fixed_um and moving_um (pixel sizes).
    """
    forms = []
    for yx in (True, False):
        for px in (True, False):
            for inverse in (False, True):
                point = {k: [F.col(f"{k}_{c}") * (F.lit(1.0) if px else F.col(f"{k}_um")) for c in (("y", "x") if yx else ("x", "y"))] for k in ("fixed", "moving")}
                a, b = (point["fixed"], point["moving"]) if inverse else (point["moving"], point["fixed"])
                forms.append(F.struct(F.lit(matrix_key(yx, px, inverse)).alias("key"), *(v.alias(n) for n, v in zip(("mx", "my", "fx", "fy"), (*a, *b), strict=True))))
    each = landmarks.select(*by, F.explode(F.array(*forms)).alias("f")).select(*by, "f.*")
    return fit_affine(each, *by, "key")
