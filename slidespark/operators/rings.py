"""Closed rings around the regions of a label image, and their simplification; no task holds a whole label or ring.

Tracing.  The straight sides of regions (`pixels.outlines`) are strung together in squares of the image first: a task gets the
sides that begin in one square and makes chains of them, closed rings among them.  Chains that go on in other squares are ranked
by pointer doubling: each knows the chain 2^k further on, so after log2 rounds it knows the first corner of its ring and how far
from there it is.

Simplification (Douglas and Peucker).  A ring is cut at its first corner and the one farthest from it; each arc is split at the
corner farthest from its chord as long as that is farther than the tolerance.  All arcs of all rings take a round together: one
aggregation and one join.  Rings of few corners are done at once, by the same rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidespark.session import ship
from slidespark.storage import drop, staged

from .pixels import outlines

#: Side of the squares whose sides one task strings together, and the most corners of a ring that one task simplifies.
SQUARE, FEW_CORNERS = 512, 4096
#: Directions of sides by number: right, down, left, up (y grows downwards).
STEPS = ((1, 0), (0, 1), (-1, 0), (0, -1))


def _direction(x1, y1, x2, y2):
    """Number of the direction of a side, of columns or numbers."""
    return (x2 < x1) * 2 + (y2 > y1) * 1 + (y2 < y1) * 3


def _string(square: int):
    """The chains of the sides of one label in one square."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x1, y1, x2, y2 = (pdf[c].to_numpy().tolist() for c in ("x1", "y1", "x2", "y2"))
        way = [_direction(*s) for s in zip(x1, y1, x2, y2, strict=True)]
        starts: dict[tuple[int, int], list[int]] = {}
        for k in range(len(x1)):
            starts.setdefault((x1[k], y1[k]), []).append(k)

        def after(k: int) -> int | None:
            """The side that follows; where a region touches itself at a corner, the one to the right."""
            ways = starts.get((x2[k], y2[k]))
            if ways is None:
                return None
            return ways[0] if len(ways) == 1 else next(j for j in ways if way[j] == (way[k] + 1) % 4)

        following = [after(k) for k in range(len(x1))]
        led = {j for j in following if j is not None}
        heads, seen, rows = [k for k in range(len(x1)) if k not in led], set(), []
        # open chains from their heads, then what is left: rings
        order = sorted(range(len(x1)), key=lambda k: (x1[k], y1[k], way[k]))
        for head in [*heads, *order]:
            if head in seen:
                continue
            chain, k = [], head
            while k is not None and k not in seen:
                seen.add(k)
                chain.append(k)
                k = following[k]
            last = chain[-1]
            low = min(range(len(chain)), key=lambda i: (x1[chain[i]], y1[chain[i]], way[chain[i]]))
            first = chain[low]
            rows.append((
                key[0], x1[head], y1[head], way[head], x2[last], y2[last], way[last], following[last] is not None, len(chain), x1[first], y1[first], way[first], low,
                [x1[k] for k in chain], [y1[k] for k in chain],
            ))
        return pd.DataFrame(rows, columns=["label", "sx", "sy", "sd", "ex", "ey", "ed", "closed", "n", "lx", "ly", "ld", "low_at", "xs", "ys"])

    return run


def _chains(sides: DataFrame, square: int) -> DataFrame:
    kind = dict(sides.dtypes)["label"]
    cells = sides.withColumns({"by": F.floor(F.col("y1") / square), "bx": F.floor(F.col("x1") / square)})
    schema = f"label {kind}, sx int, sy int, sd int, ex int, ey int, ed int, closed boolean, n long, lx int, ly int, ld int, low_at long, xs array<int>, ys array<int>"
    return cells.groupBy("label", "by", "bx").applyInPandas(_string(square), schema)


def _linked(chains: DataFrame) -> DataFrame:
    """id, next, n, low of open chains; at most two chains begin at a corner, and of two the one to the right follows."""
    begin = chains.select("label", F.col("sx").alias("ex"), F.col("sy").alias("ey"), F.col("sd").alias("nd"))
    found = chains.join(begin, ["label", "ex", "ey"])
    right = F.col("nd") == (F.col("ed") + 1) % 4
    picked = found.groupBy("label", "sx", "sy", "sd").agg(F.max_by("nd", right.cast("int")).alias("nd"), *(F.first(c).alias(c) for c in ("ex", "ey", "n", "lx", "ly", "ld")))
    return picked.select(F.struct("label", F.col("sx").alias("x"), F.col("sy").alias("y"), F.col("sd").alias("d")).alias("id"), F.struct("label", F.col("ex").alias("x"), F.col("ey").alias("y"), F.col("nd").alias("d")).alias("next"), "n", F.struct(F.col("lx").alias("x"), F.col("ly").alias("y"), F.col("ld").alias("d")).alias("low"))


def _rank(links: DataFrame) -> DataFrame:
    """id, low (first corner of the ring), ahead (sides of the ring before this chain, from the chain that has low), total."""
    t, k = staged(links, "links"), 0
    now = t.select("id", "next", "low")
    while True:
        other = now.select(F.col("id").alias("next"), F.col("next").alias("then"), F.col("low").alias("other"))
        step = staged(now.join(other, "next").select("id", F.col("then").alias("next"), F.least("low", "other").alias("low"), (F.col("other") < F.col("low")).alias("changed")), "doubled")
        changed = step.where("changed").take(1)
        if k:
            drop(now)
        now, k = step.drop("changed"), k + 1
        if not changed:  # what 2^k chains see is what 2^(k + 1) see, all around
            break
    own = t.select("id", "next", "n", F.col("low").alias("own"))
    whole = staged(own.join(now.select("id", "low"), "id"), "rings")
    heads = whole.where(F.col("own") == F.col("low")).select(F.col("id").alias("next"), F.lit(True).alias("head"))
    # each ring ends before its first chain
    cut = whole.join(heads, "next", "left").select("id", F.when(F.col("head").isNull(), F.col("next")).alias("next"), F.col("n").alias("rest"))
    now = staged(cut, "ranked")
    while now.where("next IS NOT NULL").take(1):
        other = now.select(F.col("id").alias("next"), F.col("next").alias("then"), F.col("rest").alias("more"))
        step = staged(now.join(other, "next", "left").select("id", F.col("then").alias("next"), (F.col("rest") + F.coalesce("more", F.lit(0))).alias("rest")), "ranked")
        drop(now)
        now = step
    ranked = whole.select("id", "low", "own").join(now.select("id", "rest"), "id")
    total = ranked.where(F.col("own") == F.col("low")).select(F.col("id.label").alias("label"), "low", F.col("rest").alias("total"))
    return ranked.select("id", F.col("id.label").alias("label"), "low", "rest").join(total, ["label", "low"]).select("id", "low", (F.col("total") - F.col("rest")).alias("ahead"), "total")


def _ring(x: Column, y: Column, d: Column) -> Column:
    """The number of a ring: its first corner and direction, for sides below 2^29."""
    return F.shiftleft(x.cast("long"), 32) + F.shiftleft(y.cast("long"), 2) + d


def trace(mask: DataFrame, square: int = SQUARE) -> DataFrame:
    """label, ring, i, x, y: the corners of the rings around the regions of a label image (y, x, label), in order, the region to
    the right; a ring begins at its least corner (x, then y), whose place is its number.  Holes are rings that turn the other way."""
    ship(mask.sparkSession)
    chains = staged(_chains(outlines(mask), square), "chains")
    corners = F.posexplode(F.arrays_zip(F.col("xs").alias("x"), F.col("ys").alias("y"))).alias("k", "c")

    def out(rows: DataFrame, i: Column) -> DataFrame:
        return rows.select("label", "ring", i.cast("int").alias("i"), F.col("c.x").alias("x"), F.col("c.y").alias("y"))

    rings = chains.where("closed").select("label", _ring(F.col("lx"), F.col("ly"), F.col("ld")).alias("ring"), "n", "low_at", corners)
    done = out(rings, F.pmod(F.col("k") - F.col("low_at"), F.col("n")))
    open_ = chains.where("NOT closed")
    if not open_.take(1):
        return done
    ranked = staged(_rank(_linked(open_)), "ranks")
    named = open_.withColumn("id", F.struct("label", F.col("sx").alias("x"), F.col("sy").alias("y"), F.col("sd").alias("d"))).join(ranked, "id")
    # where the ring begins within its first chain, which is the one with nothing ahead
    begin = named.where("ahead = 0").select("label", "low", F.col("low_at").alias("begin"))
    named = named.select("label", "low", "ahead", "total", "xs", "ys").join(begin, ["label", "low"])
    pieces = named.select("label", _ring(F.col("low.x"), F.col("low.y"), F.col("low.d")).alias("ring"), "ahead", "total", "begin", corners)
    return done.unionByName(out(pieces, F.pmod(F.col("ahead") + F.col("k") - F.col("begin"), F.col("total"))))


def _distance(x, y, ax, ay, bx, by):
    """Of a point from the line through a and b, or from a if they are one; of columns or arrays."""
    dx, dy = bx - ax, by - ay
    return dx, dy, (x - ax) * dy - (y - ay) * dx


def _split(x: np.ndarray, y: np.ndarray, keep: np.ndarray, a: int, b: int, epsilon: float) -> None:
    """Mark the corners to keep between a and b (b may be one round on, at n + the first)."""
    n, todo = len(x), [(a, b)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        inner = np.arange(a + 1, b) % n
        dx, dy, cross = _distance(x[inner], y[inner], x[a % n], y[a % n], x[b % n], y[b % n])
        length = np.hypot(dx, dy)
        far = np.abs(cross) / length if length else np.hypot(x[inner] - x[a % n], y[inner] - y[a % n])
        k = int(np.argmax(far))
        if far[k] > epsilon:
            keep[inner[k]] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]


def simplify_ring(x: np.ndarray, y: np.ndarray, epsilon: float) -> np.ndarray:
    """Which corners of one ring stay."""
    keep = np.zeros(len(x), bool)
    far = int(np.argmax(np.hypot(x - x[0], y - y[0])))
    keep[[0, far]] = True
    _split(x, y, keep, 0, far, epsilon)
    _split(x, y, keep, far, len(x), epsilon)
    return keep


def _simplify_few(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for label, ring, epsilon, corners in zip(b["label"], b["ring"], b["epsilon"], b["corners"], strict=True):
            i, x, y = (np.array([c[k] for c in corners], float) for k in ("i", "x", "y"))
            order = np.argsort(i)
            keep = np.flatnonzero(simplify_ring(x[order], y[order], epsilon))
            rows += [(label, ring, int(k), x[order[k]], y[order[k]]) for k in keep]
        yield pd.DataFrame(rows, columns=["label", "ring", "i", "x", "y"])


def simplify(rings: DataFrame, epsilon: float = 1.0, of_length: bool = False, few: int = FEW_CORNERS) -> DataFrame:
    """label, ring, i, x, y: the corners of rings (i: as before) that stay when none may be farther than epsilon from the new
    sides; with of_length, epsilon is a share of a ring's length."""
    ship(rings.sparkSession)
    kind = dict(rings.dtypes)["label"]
    rings = staged(rings.select("label", "ring", "i", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), "corners")
    nothing = rings.groupBy("label", "ring").agg(F.count(F.lit(1)).alias("n"))
    if of_length:
        following = rings.select("label", "ring", (F.col("i") - 1).alias("i"), F.col("x").alias("u"), F.col("y").alias("v"))
        wrap = rings.where("i = 0").select("label", "ring", F.col("x").alias("u0"), F.col("y").alias("v0"))
        sides = rings.join(following, ["label", "ring", "i"], "left").join(wrap, ["label", "ring"])
        length = F.hypot(F.coalesce("u", "u0") - F.col("x"), F.coalesce("v", "v0") - F.col("y"))
        sizes = sides.groupBy("label", "ring").agg(F.count(F.lit(1)).alias("n"), (F.sum(length) * epsilon).alias("epsilon"))
    else:
        sizes = nothing.withColumn("epsilon", F.lit(float(epsilon)))
    sizes = staged(sizes, "ring-sizes")
    small = rings.join(sizes.where(F.col("n") <= few), ["label", "ring"]).groupBy("label", "ring", "epsilon").agg(F.collect_list(F.struct("i", "x", "y")).alias("corners"))
    done = small.mapInPandas(_simplify_few, f"label {kind}, ring long, i int, x double, y double")
    large = sizes.where(F.col("n") > few)
    if not large.take(1):
        return done
    return done.unionByName(_simplify_many(rings.join(large, ["label", "ring"])))


def _simplify_many(corners: DataFrame) -> DataFrame:
    """Rings of any size, a round for all arcs at a time; an arc is named by its first corner's i, its last may be n (the first)."""
    first = corners.where("i = 0").select("label", "ring", F.col("x").alias("ax"), F.col("y").alias("ay"))
    start = corners.join(first, ["label", "ring"])
    far = start.groupBy("label", "ring").agg(F.max_by(F.struct("i", "x", "y"), F.struct(F.hypot(F.col("x") - F.col("ax"), F.col("y") - F.col("ay")), -F.col("i"))).alias("far"))
    arcs = start.join(far, ["label", "ring"])
    ahead = F.col("i") < F.col("far.i")
    arcs = arcs.select(
        "label", "ring", "i", "x", "y", "epsilon", F.col("n").cast("int").alias("n"), (F.col("i").isin(0) | (F.col("i") == F.col("far.i"))).alias("kept"),
        F.when(ahead, 0).otherwise(F.col("far.i")).alias("lo"), *(F.when(ahead, F.col(f"a{c}")).otherwise(F.col(f"far.{c}")).alias(f"a{c}") for c in "xy"),
        *(F.when(ahead, F.col(f"far.{c}")).otherwise(F.col(f"a{c}")).alias(f"b{c}") for c in "xy"),
    )
    now, open_ = staged(arcs, "arcs"), True
    while open_:
        dx, dy, cross = _distance(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
        length = F.hypot(dx, dy)
        away = F.when(length > 0, F.abs(cross) / length).otherwise(F.hypot(F.col("x") - F.col("ax"), F.col("y") - F.col("ay")))
        inner = now.where(~F.col("kept")).withColumn("away", away)
        split = inner.groupBy("label", "ring", "lo").agg(F.max_by(F.struct("i", "x", "y"), F.struct("away", -F.col("i"))).alias("at"), F.max("away").alias("away"), F.first("epsilon").alias("e"))
        split = split.where("away > e").select("label", "ring", "lo", "at")
        found = now.join(split, ["label", "ring", "lo"], "left")
        before, behind = F.col("at").isNotNull() & (F.col("i") < F.col("at.i")), F.col("at").isNotNull() & (F.col("i") >= F.col("at.i"))
        step = staged(
            found.select(
                "label", "ring", "i", "x", "y", "epsilon", "n", (F.col("kept") | (F.col("at").isNotNull() & (F.col("i") == F.col("at.i")))).alias("kept"), F.when(behind, F.col("at.i")).otherwise(F.col("lo")).alias("lo"),
                *(F.when(behind, F.col(f"at.{c}")).otherwise(F.col(f"a{c}")).alias(f"a{c}") for c in "xy"), *(F.when(before, F.col(f"at.{c}")).otherwise(F.col(f"b{c}")).alias(f"b{c}") for c in "xy"),
                (F.col("at").isNotNull()).alias("moved"),
            ),
            "arcs",
        )
        open_ = bool(step.where("moved").take(1))
        drop(now)
        now = step.drop("moved")
    return now.where("kept").select("label", "ring", "i", "x", "y")
