"""Least-squares transforms of point pairs (mx, my to fx, fy), one for each group, from sums over the pairs.

The pairs are read twice: once for the centres and spreads of each group, once for sums of products of the centred and scaled
coordinates, with partial sums as in any aggregation.  What is left of a group is one row of sums; a small matrix made of it is
solved.  Groups without a solution (too few points, or all on a line) get nulls.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidespark.session import ship

KINDS = ("euclidean", "similarity", "affine", "projective", "polynomial")
MATRIX = [f"m{i}{j}" for i in range(3) for j in range(3)]
#: Exponents of x and y of the terms of a polynomial of the second order.
TERMS = ((0, 0), (1, 0), (0, 1), (2, 0), (1, 1), (0, 2))
COEFFICIENTS = [f"{c}{k}" for c in ("x", "y") for k in range(len(TERMS))]
#: Least share of the largest singular value (or second smallest, for a null vector) that counts as a solution.
RANK = 1e-9


def _products(kind: str) -> dict[str, tuple[tuple[int, int], str]]:
    """The sums that a kind needs: name, exponents of the moving coordinates u and v, and what they are multiplied by."""
    if kind == "polynomial":
        out = {f"t{i}_{j}": ((i, j), "1") for i in range(5) for j in range(5 - i)}
        return out | {f"{w}{i}_{j}": ((i, j), w) for w in ("p", "q") for i, j in TERMS}
    out = {f"t{i}_{j}": ((i, j), "1") for i in range(3) for j in range(3 - i)}
    out |= {f"{w}{i}_{j}": ((i, j), w) for w in ("p", "q") for i in range(3) for j in range(3 - i)}
    return out | ({f"d{i}_{j}": ((i, j), "d") for i in range(3) for j in range(3 - i)} if kind == "projective" else {})


def _block(s: dict, w: str) -> np.ndarray:
    """Sum of w times the products of (u, v, 1)."""
    e = ((1, 0), (0, 1), (0, 0))
    return np.array([[s[f"{w}{a[0] + b[0]}_{a[1] + b[1]}"] for b in e] for a in e])


def _plane(scale: float, cx: float, cy: float) -> np.ndarray:
    """The matrix to centred and scaled coordinates."""
    return np.array([[1 / scale, 0, -cx / scale], [0, 1 / scale, -cy / scale], [0, 0, 1]])


def _matrix(kind: str, s: dict) -> np.ndarray | None:
    """Of one group, in its own coordinates."""
    if kind in ("euclidean", "similarity"):
        # as complex numbers: the turn and scale that bring the moving points nearest to the fixed ones
        turn = complex(s["p1_0"] + s["q0_1"], s["q1_0"] - s["p0_1"])
        size = s["t2_0"] + s["t0_2"]
        if not size or not abs(turn):
            return None
        z = turn / abs(turn) * (s["moving_scale"] / s["fixed_scale"] if kind == "euclidean" else abs(turn) / size)
        own = np.array([[z.real, -z.imag, 0], [z.imag, z.real, 0], [0, 0, 1]])
    elif kind == "affine":
        a = _block(s, "t")
        if np.linalg.cond(a) > 1 / RANK:
            return None
        own = np.vstack([np.linalg.solve(a, _block(s, w)[:, 2]) for w in ("p", "q")] + [[0, 0, 1]])
    else:
        a, b, c, d, zero = _block(s, "t"), _block(s, "p"), _block(s, "q"), _block(s, "d"), np.zeros((3, 3))
        values, vectors = np.linalg.eigh(np.block([[a, zero, -b], [zero, a, -c], [-b, -c, d]]))
        if values[1] <= RANK * values[-1]:
            return None
        own = vectors[:, 0].reshape(3, 3)
    whole = np.linalg.inv(_plane(s["fixed_scale"], s["fx"], s["fy"])) @ own @ _plane(s["moving_scale"], s["mx"], s["my"])
    return whole / whole[2, 2] if whole[2, 2] else None


def _polynomial(s: dict) -> np.ndarray | None:
    """Coefficients of both coordinates, in the group's own coordinates."""
    t = np.array([[s[f"t{a[0] + b[0]}_{a[1] + b[1]}"] for b in TERMS] for a in TERMS])
    if np.linalg.cond(t) > 1 / RANK:
        return None
    out = []
    # the terms of u = (x - cx) / r and v by those of x and y
    r, c = s["moving_scale"], (s["mx"], s["my"])
    line = [{(1, 0): 1 / r, (0, 0): -c[0] / r}, {(0, 1): 1 / r, (0, 0): -c[1] / r}]
    for w, centre in (("p", s["fx"]), ("q", s["fy"])):
        own, total = np.linalg.solve(t, np.array([s[f"{w}{i}_{j}"] for i, j in TERMS])), dict.fromkeys(TERMS, 0.0)
        for k, (i, j) in zip(own, TERMS, strict=True):
            product = {(0, 0): k}
            for factor in [line[0]] * i + [line[1]] * j:
                grown: dict = {}
                for e, v in product.items():
                    for f, u in factor.items():
                        key = (e[0] + f[0], e[1] + f[1])
                        grown[key] = grown.get(key, 0.0) + v * u
                product = grown
            for e, v in product.items():
                total[e] += v
        out += [total[e] * s["fixed_scale"] + (centre if e == (0, 0) else 0.0) for e in TERMS]
    return np.array(out)


def _solve(kind: str, by: list[str]):
    names = COEFFICIENTS if kind == "polynomial" else MATRIX

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for s in b.to_dict("records"):
                usable = all(s[k] and np.isfinite(s[k]) for k in ("moving_scale", "fixed_scale"))
                found = (_polynomial(s) if kind == "polynomial" else _matrix(kind, s)) if usable else None
                rows.append([s[c] for c in by] + [s["n"], *([None] * len(names) if found is None else found.ravel().tolist())])
            yield pd.DataFrame(rows, columns=[*by, "n", *names])

    return run


def fit(pairs: DataFrame, kind: str, *by: str) -> DataFrame:
    """by, n, and m00 .. m22, or for polynomials x0 .. x5 and y0 .. y5 (of 1, x, y, x^2, xy, y^2), of each group.

    Pairs with a null are left out.  euclidean: turn and shift; similarity: with a scale; polynomial: of the second order.
    """
    if kind not in KINDS:
        raise ValueError(f"no transform {kind!r}")
    ship(pairs.sparkSession)
    keys = list(by) or ["_all"]
    p = pairs.na.drop(subset=["mx", "my", "fx", "fy"])
    p = p.select(*(by or [F.lit(0).alias("_all")]), *(F.col(c).cast("double").alias(c) for c in ("mx", "my", "fx", "fy")))
    centres = p.groupBy(*keys).agg(
        *(F.avg(c).alias(f"_{c}") for c in ("mx", "my", "fx", "fy")), F.sqrt(F.var_pop("mx") + F.var_pop("my")).alias("moving_scale"), F.sqrt(F.var_pop("fx") + F.var_pop("fy")).alias("fixed_scale")
    )
    own = p.join(centres, keys)
    u, v = ((F.col(f"m{c}") - F.col(f"_m{c}")) / F.nullif(F.col("moving_scale"), F.lit(0.0)) for c in ("x", "y"))
    a, b = ((F.col(f"f{c}") - F.col(f"_f{c}")) / F.nullif(F.col("fixed_scale"), F.lit(0.0)) for c in ("x", "y"))
    by_what = {"1": F.lit(1.0), "p": a, "q": b, "d": a * a + b * b}

    def power(c, k: int):
        out = F.lit(1.0)
        for _ in range(k):
            out = out * c
        return out

    sums = [F.sum(power(u, i) * power(v, j) * by_what[w]).alias(name) for name, ((i, j), w) in _products(kind).items()]
    held = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.first(f"_{c}").alias(c) for c in ("mx", "my", "fx", "fy")), *(F.first(c).alias(c) for c in ("moving_scale", "fixed_scale")), *sums)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in p.select(*keys).schema)
    names = COEFFICIENTS if kind == "polynomial" else MATRIX
    return held.mapInPandas(_solve(kind, keys), f"{types}, n long, " + ", ".join(f"{c} double" for c in names)).select(*by, "n", *names)
