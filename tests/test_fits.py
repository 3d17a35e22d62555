"""Transforms of point pairs and displacement fields against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slidespark.operators import fields, fits, vectors


def pairs_of(spark, groups):
    rows = [(g, *map(float, m), *map(float, f)) for g, (ms, fs) in groups.items() for m, f in zip(ms, fs, strict=True)]
    return spark.createDataFrame(rows, "g string, mx double, my double, fx double, fy double").repartition(3)


def matrix_of(row):
    return np.array([row[c] for c in fits.MATRIX]).reshape(3, 3)


def homogeneous(m, p):
    q = np.c_[p, np.ones(len(p))] @ m.T
    return q[:, :2] / q[:, 2:]


@pytest.fixture(scope="module")
def points():
    return np.random.default_rng(0).uniform(-50, 400, (60, 2))


def test_similarity_and_euclidean(spark, points):
    """Against Procrustes by a singular value decomposition, with noise."""
    rng, groups = np.random.default_rng(1), {}
    for k, (s, a) in enumerate(((1.0, 0.3), (2.5, -2.0), (0.2, 3.1))):
        turn = s * np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])
        groups[f"g{k}"] = points, points @ turn.T + [10, -700] + rng.normal(size=points.shape)
    for kind in ("similarity", "euclidean"):
        for row in fits.fit(pairs_of(spark, groups), kind, "g").collect():
            m, f = groups[row["g"]]
            a, b = m - m.mean(0), f - f.mean(0)
            u, d, v = np.linalg.svd(b.T @ a)
            fix = np.diag([1, np.linalg.det(u @ v)])
            turn = u @ fix @ v * (np.trace(np.diag(d) @ fix) / (a**2).sum() if kind == "similarity" else 1.0)
            want = np.vstack([np.c_[turn, f.mean(0) - turn @ m.mean(0)], [0, 0, 1]])
            assert np.allclose(matrix_of(row), want, atol=1e-9) and row["n"] == len(m)


def test_affine_is_that_of_the_other_fit(spark, points):
    f = points @ np.array([[0.9, 0.1], [-0.3, 1.4]]).T + np.random.default_rng(2).normal(size=points.shape)
    df = pairs_of(spark, {"a": (points, f)})
    a, b = fits.fit(df, "affine").first(), vectors.fit_affine(df).first()
    assert all(abs(a[c] - b[c]) < 1e-9 for c in fits.MATRIX[:6])


def test_projective(spark, points):
    m = np.array([[1.2, 0.1, 30], [-0.2, 0.8, -5], [0.0004, -0.0003, 1]])
    exact = homogeneous(m, points)
    noisy = exact + np.random.default_rng(3).normal(scale=0.5, size=exact.shape)
    found = {r["g"]: matrix_of(r) for r in fits.fit(pairs_of(spark, {"exact": (points, exact), "noisy": (points, noisy)}), "projective", "g").collect()}
    assert np.allclose(found["exact"], m, atol=1e-8)

    def plain(src, dst):
        """The direct linear transform of centred and scaled points."""
        def own(p):
            c, s = p.mean(0), np.sqrt(p.var(0).sum())
            return np.array([[1 / s, 0, -c[0] / s], [0, 1 / s, -c[1] / s], [0, 0, 1]])

        t, u = own(src), own(dst)
        a, b = homogeneous(t, src), homogeneous(u, dst)
        rows = []
        for (x, y), (p, q) in zip(a, b, strict=True):
            rows += [[x, y, 1, 0, 0, 0, -p * x, -p * y, -p], [0, 0, 0, x, y, 1, -q * x, -q * y, -q]]
        h = np.linalg.svd(np.array(rows))[2][-1].reshape(3, 3)
        h = np.linalg.inv(u) @ h @ t
        return h / h[2, 2]

    assert np.allclose(found["noisy"], plain(points, noisy), rtol=1e-6, atol=1e-8)


def test_polynomial(spark, points):
    terms = np.stack([points[:, 0] ** i * points[:, 1] ** j for i, j in fits.TERMS], axis=1)
    c = np.array([[3, 1.1, -0.2, 1e-4, 2e-4, -3e-4], [-8, 0.1, 0.7, 0, 5e-4, 1e-5]])
    noisy = terms @ c.T + np.random.default_rng(4).normal(size=points.shape)
    found = {r["g"]: [r[k] for k in fits.COEFFICIENTS] for r in fits.fit(pairs_of(spark, {"exact": (points, terms @ c.T), "noisy": (points, noisy)}), "polynomial", "g").collect()}
    assert np.allclose(found["exact"], c.ravel(), rtol=1e-6, atol=1e-7)
    assert np.allclose(found["noisy"], np.linalg.lstsq(terms, noisy, rcond=None)[0].T.ravel(), rtol=1e-5, atol=1e-6)


def test_groups_without_a_solution(spark):
    line = np.array([[k, 2 * k] for k in range(6)], float)
    one = np.array([[1, 1]], float)
    df = pairs_of(spark, {"line": (line, line), "one": (one, one), "same": (one.repeat(5, 0), line[:5])}).unionByName(spark.createDataFrame([("nulls", None, 1.0, 1.0, 1.0)], "g string, mx double, my double, fx double, fy double"))
    for kind in fits.KINDS:
        found = {r["g"]: r for r in fits.fit(df, kind, "g").collect()}
        assert set(found) == {"line", "one", "same"} and found["one"][2] is None and found["same"][2] is None
        assert (found["line"][2] is None) == (kind not in ("similarity", "euclidean"))
    assert fits.fit(df.limit(0), "affine").collect() == []
    with pytest.raises(ValueError):
        fits.fit(df, "spline")


# displacement fields


@pytest.fixture(scope="module")
def grid():
    rng = np.random.default_rng(5)
    return rng.uniform(-2, 2, (7, 9, 2))  # dy, dx of nodes that are 10 apart


def field_of(spark, grid, step=10.0):
    rows = [(y, x, float(grid[y, x, 0]), float(grid[y, x, 1])) for y in range(grid.shape[0]) for x in range(grid.shape[1])]
    return fields.field(spark.createDataFrame(rows, "gy int, gx int, dy double, dx double").repartition(2), step)


def plain(grid, p, step=10.0):
    """Displacements (dx, dy) of points (x, y)."""
    out = []
    for x, y in p:
        v, u = min(max(y / step, 0), grid.shape[0] - 1), min(max(x / step, 0), grid.shape[1] - 1)
        j, i = min(int(v), grid.shape[0] - 2), min(int(u), grid.shape[1] - 2)
        v, u = v - j, u - i
        d = (grid[j, i] * (1 - u) + grid[j, i + 1] * u) * (1 - v) + (grid[j + 1, i] * (1 - u) + grid[j + 1, i + 1] * u) * v
        out.append(d[::-1])
    return np.array(out)


def table(spark, p):
    return spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(p)], "k int, x double, y double").repartition(3)


def array(df):
    return np.array([[r["x"], r["y"]] for r in df.orderBy("k").collect()])


def test_move_and_back(spark, grid, monkeypatch):
    p = np.random.default_rng(6).uniform(-15, 95, (300, 2))
    f = field_of(spark, grid)
    moved = fields.move(table(spark, p), f)
    assert moved.columns == ["k", "x", "y"] and np.allclose(array(moved), p + plain(grid, p), atol=1e-12)
    back = fields.move_back(moved, f)
    assert back.columns == ["k", "x", "y"] and np.allclose(array(back), p, atol=1e-7)
    # the same with cells that are too many to be sent about
    monkeypatch.setattr(fields, "FEW_CELLS", 0)
    joined = field_of(spark, grid)
    assert not joined.few and np.allclose(array(fields.move(table(spark, p), joined)), p + plain(grid, p), atol=1e-12)


def test_chain_and_inverse(spark, grid):
    f, g = field_of(spark, grid), field_of(spark, grid[::-1] * 0.5)
    nodes = np.array([[x * 10.0, y * 10.0] for y in range(7) for x in range(9)])
    both = fields.chain(f, g)
    there = nodes + plain(grid, nodes)
    assert np.allclose(array(fields.move(table(spark, nodes), both)), there + plain(grid[::-1] * 0.5, there), atol=1e-9)
    inv = fields.inverse(f)
    back = array(fields.move(table(spark, nodes), inv))
    assert np.allclose(back + plain(grid, back), nodes, atol=1e-7)


def test_fields_that_fail(spark, grid):
    with pytest.raises(ValueError, match="two by two"):
        fields.field(spark.createDataFrame([(0, 0, 1.0, 1.0)], "gy int, gx int, dy double, dx double"), 1.0)
    wild = field_of(spark, grid * 40)
    with pytest.raises(ValueError, match="cannot be inverted"):
        fields.move_back(table(spark, np.random.default_rng(7).uniform(0, 60, (50, 2))), wild, most=12)
    assert fields.move_back(table(spark, np.zeros((1, 2))).limit(0), field_of(spark, grid)).count() == 0
    rows = field_of(spark, grid).at(spark.createDataFrame([(1, None, 3.0)], "k int, x double, y double")).select(F.col("dx").isNull() | (F.col("dx") == 0)).first()
    assert rows[0]


def test_back_meets_the_nodes_once(spark, grid, monkeypatch):
    """However many steps it takes, points are written before and after them only, few cells or many; with holes in the field,
    points beyond it and points that lack a coordinate."""
    rows = [(y, x, float(grid[y, x, 0]), float(grid[y, x, 1])) for y in range(7) for x in range(9) if (y, x) not in ((3, 4), (6, 8))]
    p = np.random.default_rng(8).uniform(-15, 95, (300, 2))
    for few in (fields.FEW_CELLS, 0):
        monkeypatch.setattr(fields, "FEW_CELLS", few)
        f = fields.field(spark.createDataFrame(rows, "gy int, gx int, dy double, dx double"), 10.0)
        made, staged = [], fields.staged
        # what holes move nothing is moved to stays; elsewhere forward and back must agree
        moved = fields.move(table(spark, p), f).unionByName(spark.createDataFrame([(900, None, 3.0), (901, 4.0, None)], "k int, x double, y double"))
        with monkeypatch.context() as m:
            m.setattr(fields, "staged", lambda df, name: made.append(name) or staged(df, name))
            back = fields.move_back(moved, f)
        assert len(made) == 2 and back.columns == ["k", "x", "y"]
        assert [(r["k"], r["x"], r["y"]) for r in back.where("k >= 900").orderBy("k").collect()] == [(900, None, 3.0), (901, 4.0, None)]
        assert np.allclose(array(fields.move(back.where("k < 900"), f)), array(moved.where("k < 900")), atol=1e-7)
