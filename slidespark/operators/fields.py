"""Displacement fields: non-rigid transforms as a table of the nodes of a grid (gy, gx, dy, dx), `step` apart.

A point is moved by the bilinear mean of the four nodes around it; beyond the grid, by what its edge says.  The nodes are turned
into cells that have all four corners, once, so moving points takes one join by cell.  A field is inverted by fixed-point steps
(q = p - d(q)), which converge where displacements change by less than the distance between points.  No step leads farther from p
than the largest displacement, so each point meets the nodes around its cell once and takes all its steps where it then is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidespark.session import ship
from slidespark.storage import drop, staged

#: Most cells that are sent to every task, and the steps of an inversion between two looks at what changes.
FEW_CELLS, STEPS = 1 << 18, 6
#: How many cells displacements may reach for points to take the nodes around them along.
NEAR = 3


@dataclass
class Field:
    """cells: cy, cx and dy, dx of the corners (dy00, dy01, dy10, dy11 and so on, y first); rows and columns of cells."""

    cells: DataFrame
    step: float
    rows: int
    columns: int
    few: bool

    def placed(self, points: DataFrame, x: str, y: str) -> DataFrame:
        """points with _y and _x, where they are in cells, and the cell cy, cx."""
        place = {"_y": (F.col(y) / self.step, self.rows), "_x": (F.col(x) / self.step, self.columns)}
        points = points.withColumns({k: F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(0.0)), F.lit(float(n)))) for k, (v, n) in place.items()})
        return points.withColumns({"cy": F.least(F.floor("_y"), F.lit(self.rows - 1)).cast("int"), "cx": F.least(F.floor("_x"), F.lit(self.columns - 1)).cast("int")})

    def reach(self) -> int | None:
        """How many cells away a point can be moved; None if a displacement is no number."""
        corners = [F.abs(F.col(f"{c}{i}{j}")) for c in ("dy", "dx") for i in (0, 1) for j in (0, 1)]
        most = self.cells.agg(F.max(F.greatest(*corners))).first()[0]
        return math.ceil((most or 0.0) / self.step) if most is None or math.isfinite(most) else None

    def at(self, points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
        """points with dx and dy; 0 for a point that lacks a coordinate."""
        points = self.placed(points, x, y)
        met = points.join(F.broadcast(self.cells) if self.few else self.cells, ["cy", "cx"], "left")
        v, u = F.col("_y") - F.col("cy"), F.col("_x") - F.col("cx")

        def mean(c: str) -> Column:
            top = F.col(f"{c}00") * (1 - u) + F.col(f"{c}01") * u
            return top * (1 - v) + (F.col(f"{c}10") * (1 - u) + F.col(f"{c}11") * u) * v

        ends = [f"{c}{i}{j}" for c in ("dy", "dx") for i in (0, 1) for j in (0, 1)]
        return met.withColumns({c: F.coalesce(mean(c), F.lit(0.0)) for c in ("dy", "dx")}).drop("_y", "_x", "cy", "cx", *ends)


def field(nodes: DataFrame, step: float) -> Field:
    """Of nodes gy, gx (from 0), dy, dx; a cell that lacks a node moves nothing."""
    corner = F.explode(F.array(*(F.struct((F.col("gy") - i).alias("cy"), (F.col("gx") - j).alias("cx"), F.lit(f"{i}{j}").alias("k")) for i in (0, 1) for j in (0, 1)))).alias("c")
    each = nodes.select("dy", "dx", corner).select("dy", "dx", "c.*")
    cells = each.groupBy("cy", "cx").agg(*(F.max(F.when(F.col("k") == f"{i}{j}", F.col(c))).alias(f"{c}{i}{j}") for c in ("dy", "dx") for i in (0, 1) for j in (0, 1)), F.count(F.lit(1)).alias("n"))
    cells = staged(cells.where("n = 4").drop("n").withColumns({c: F.col(c).cast("int") for c in ("cy", "cx")}), "cells")
    size = cells.agg(F.max("cy"), F.max("cx"), F.count(F.lit(1))).first()
    if not size[2]:
        raise ValueError("a field needs two by two nodes")
    return Field(cells, float(step), size[0] + 1, size[1] + 1, size[2] <= FEW_CELLS)


def move(points: DataFrame, by: Field, x: str = "x", y: str = "y") -> DataFrame:
    """points moved by a field."""
    return by.at(points, x, y).withColumns({x: F.col(x) + F.col("dx"), y: F.col(y) + F.col("dy")}).drop("dx", "dy")


def move_back(points: DataFrame, by: Field, x: str = "x", y: str = "y", tolerance: float = 1e-9, most: int = 300) -> DataFrame:
    """The points that a field moves to these, to within tolerance; an error if `most` steps are not enough."""
    reach = by.reach()
    if reach is None or reach > NEAR:
        return _far_back(points, by, x, y, tolerance, most)
    ship(points.sparkSession)
    here = staged(by.placed(points, x, y).drop("_y", "_x"), "to-move-back")
    around = _around(by, here.select("cy", "cx").distinct(), reach)
    met = here.join(around, ["cy", "cx"], "left")
    kinds = {f.name: f.dataType.simpleString() for f in points.schema} | {x: "double", y: "double"}
    out = ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", _off double"
    back = staged(met.mapInArrow(_steps_back(by.step, by.rows, by.columns, reach, x, y, tolerance, most), out), "moved-back")
    drop(here)
    off = back.agg(F.max("_off")).first()[0]
    if off is not None and not off <= tolerance:
        raise ValueError(f"the field cannot be inverted by fixed-point steps: still {off} off after {most}")
    return back.drop("_off")


def _around(by: Field, homes: DataFrame, reach: int) -> DataFrame:
    """For each of these cells the displacements (dys, dxs) of the nodes around it, row by row, null where there is none."""
    side = 2 * reach + 2
    corners = F.explode(F.array(*(F.struct((F.col("cy") + i).alias("gy"), (F.col("cx") + j).alias("gx"), F.col(f"dy{i}{j}").alias("dy"), F.col(f"dx{i}{j}").alias("dx")) for i in (0, 1) for j in (0, 1)))).alias("c")
    nodes = by.cells.select(corners).select("c.*").groupBy("gy", "gx").agg(F.max("dy").alias("dy"), F.max("dx").alias("dx"))
    to = F.explode(F.array(*(F.struct((F.col("gy") + reach - i).alias("cy"), (F.col("gx") + reach - j).alias("cx"), F.lit(i * side + j).alias("k")) for i in range(side) for j in range(side)))).alias("c")
    few = homes.limit(FEW_CELLS // side**2 + 1).count() <= FEW_CELLS // side**2
    met = nodes.select("dy", "dx", to).select("dy", "dx", "c.*").join(F.broadcast(homes) if few else homes, ["cy", "cx"], "left_semi")
    own = met.groupBy("cy", "cx").agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct("dy", "dx")))).alias("at"))
    every = F.sequence(F.lit(0), F.lit(side**2 - 1))
    nodes_of = own.withColumn("at", F.transform(every, lambda k: F.try_element_at("at", k)))
    out = nodes_of.select("cy", "cx", F.col("at.dy").alias("dys"), F.col("at.dx").alias("dxs"))
    return F.broadcast(out) if few else out


def _steps_back(step: float, rows: int, columns: int, reach: int, x: str, y: str, tolerance: float, most: int):
    """Each point to the one that is moved to it, with _off, the length of its last step."""
    side = 2 * reach + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = dict(zip(b.schema.names, b.columns, strict=True))
            cy, cx, lists, ends = held.pop("cy"), held.pop("cx"), [held.pop("dys"), held.pop("dxs")], {c: held[c].cast(pa.float64()) for c in (x, y)}
            off = np.zeros(b.num_rows)
            # a point without a coordinate, or that has no node around it, stays where it is
            own = np.flatnonzero(np.all([v.is_valid().to_numpy(False) for v in (*ends.values(), lists[0])], axis=0))
            dy, dx = (v.take(pa.array(own)).flatten().to_numpy(False).astype(np.float64).reshape(len(own), side * side) for v in lists)
            top, left = (v.take(pa.array(own)).to_numpy(False) - reach for v in (cy, cx))
            (py, qy), (px, qx) = ((v, v.copy()) for v in (ends[c].to_numpy(False)[own] for c in (y, x)))
            moves = np.arange(len(own))
            for _ in range(most):
                v, u = np.clip(qy[moves] / step, 0.0, rows), np.clip(qx[moves] / step, 0.0, columns)
                v, u = np.where(np.isnan(v), float(rows), v), np.where(np.isnan(u), float(columns), u)
                j, i = np.minimum(np.floor(v), rows - 1).astype(np.int64), np.minimum(np.floor(u), columns - 1).astype(np.int64)
                v, u, k = v - j, u - i, (j - top[moves]) * side + i - left[moves]
                new = []
                for p, d in ((py, dy), (px, dx)):
                    mean = (d[moves, k] * (1 - u) + d[moves, k + 1] * u) * (1 - v) + (d[moves, k + side] * (1 - u) + d[moves, k + side + 1] * u) * v
                    new.append(p[moves] - np.where(np.isnan(mean), 0.0, mean))
                last = [np.where((a == b) | (np.isnan(a) & np.isnan(b)), 0.0, np.abs(a - b)) for a, b in ((new[0], qy[moves]), (new[1], qx[moves]))]
                qy[moves], qx[moves], off[own[moves]] = *new, np.maximum(*last)
                moves = moves[off[own[moves]] > tolerance]
                if not len(moves):
                    break
            for c, q in ((x, qx), (y, qy)):
                all_of = np.array(ends[c].to_numpy(False), np.float64)
                all_of[own] = q
                held[c] = pa.array(all_of, mask=ends[c].is_null().to_numpy(False))
            yield pa.RecordBatch.from_arrays([*held.values(), pa.array(off)], [*held, "_off"])

    return run


def _far_back(points: DataFrame, by: Field, x: str, y: str, tolerance: float, most: int) -> DataFrame:
    """The same where displacements reach farther: a join for each step."""
    now = points.withColumns({"_px": F.col(x), "_py": F.col(y)})
    done, held = 0, None
    while True:
        for _ in range(STEPS if by.few else 1):
            now = by.at(now, x, y).withColumns({"_qx": F.col("_px") - F.col("dx"), "_qy": F.col("_py") - F.col("dy")})
            now = now.withColumns({"_off": F.greatest(F.abs(F.col("_qx") - F.col(x)), F.abs(F.col("_qy") - F.col(y))), x: F.col("_qx"), y: F.col("_qy")}).drop("dx", "dy", "_qx", "_qy")
            done += 1
        step = staged(now, "moved-back")
        if held is not None:
            drop(held)
        held = step
        off = step.agg(F.max("_off")).first()[0]
        now = step.drop("_off")
        if off is None or off <= tolerance:
            return now.drop("_px", "_py")
        if done >= most:
            raise ValueError(f"the field cannot be inverted by fixed-point steps: still {off} off after {done}")


def _nodes(by: Field) -> DataFrame:
    """The places of the nodes of a field."""
    spark = by.cells.sparkSession
    at = spark.range((by.rows + 1) * (by.columns + 1)).select(F.floor(F.col("id") / (by.columns + 1)).cast("int").alias("gy"), (F.col("id") % (by.columns + 1)).cast("int").alias("gx"))
    return at.withColumns({"y": F.col("gy") * by.step, "x": F.col("gx") * by.step})


def chain(first: Field, second: Field) -> Field:
    """The field that moves as one after the other, at the first one's nodes."""
    moved = move(move(_nodes(first), first), second)
    return field(moved.select("gy", "gx", (F.col("y") - F.col("gy") * first.step).alias("dy"), (F.col("x") - F.col("gx") * first.step).alias("dx")), first.step)


def inverse(by: Field, tolerance: float = 1e-9) -> Field:
    """The field that moves back, exact at the nodes."""
    back = move_back(_nodes(by), by, tolerance=tolerance)
    return field(back.select("gy", "gx", (F.col("y") - F.col("gy") * by.step).alias("dy"), (F.col("x") - F.col("gx") * by.step).alias("dx")), by.step)
