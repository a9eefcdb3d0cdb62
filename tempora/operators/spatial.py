"""Spatial joins: both sides meet on cells, the exact test is the residual."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions import geo as g
from tempora.operators.edgecells import edge_cells, points_in_cells


def cell(c, size: float) -> Column:
    return F.floor(c / size).cast("long")


def cells_around(c, size: float) -> Column:
    """A coordinate's cell and both neighbours."""
    return F.sequence(cell(c, size) - 1, cell(c, size) + 1)


def cells_of(lo, hi, size: float) -> Column:
    return F.sequence(cell(lo, size), cell(hi, size))


def ring_boxes(rings: DataFrame, rid: str = "rid") -> DataFrame:
    return rings.groupBy(rid).agg(F.min("qlat").alias("y0"), F.max("qlat").alias("y1"), F.min("qlon").alias("x0"), F.max("qlon").alias("x1"))


def ring_edges(rings: DataFrame, rid: str = "rid") -> DataFrame:
    """rid, seq, ay, ax, by_, bx: each vertex with the next, the last with the first."""
    w = Window.partitionBy(rid).orderBy("seq")
    nxt = F.lead(F.struct("qlat", "qlon")).over(w)
    first = F.first(F.struct("qlat", "qlon")).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    n = F.coalesce(nxt, first)
    return rings.select(rid, "seq", F.col("qlat").alias("ay"), F.col("qlon").alias("ax"), n.alias("n")).select(rid, "seq", "ay", "ax", F.col("n.qlat").alias("by_"), F.col("n.qlon").alias("bx"))


def points_in_rings(points: DataFrame, rings: DataFrame) -> DataFrame:
    """(k, rid): the rings that hold each point (k, y, x)."""
    return points_in_cells(points, edge_cells(ring_edges(rings)))


DENSE = 4_000  # points of a cell that one task compares with those around them


def pairs_within(points: DataFrame, radius: float, dense: int = DENSE) -> DataFrame:
    """Pairs (a < b, w) of the points at most ``radius`` radians apart, where many lie close.

    Two cells meet in one direction only, so a pair is compared once; the cosine decides before the angle is taken, and a cell of more than
    ``dense`` points is cut into parts, each of which meets the points around it in a task of its own."""
    size = 2.0 * math.sin(min(radius, math.pi) / 2.0) + 1e-12
    own = [cell(F.col(f"v.{c}"), size).alias(f"c{c}") for c in "xyz"]
    ahead = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) >= (0, 0, 0)]
    cells = ["cx", "cy", "cz"]
    placed = points.select("k", "v", *own)
    parts = placed.groupBy(*cells).agg(F.ceil(F.count("*") / dense).cast("int").alias("parts"))
    here = placed.join(parts, cells).select(F.col("k").alias("a"), F.col("v").alias("va"), *cells, F.pmod(F.xxhash64("k"), F.col("parts")).cast("int").alias("part"))
    steps = F.explode(F.array(*[F.struct(*[F.lit(d).alias(c) for c, d in zip("xyz", s, strict=True)]) for s in ahead]))
    there = placed.withColumn("s", steps).select(F.col("k").alias("b"), F.col("v").alias("vb"), "s", *[(F.col(f"c{c}") + F.col(f"s.{c}")).alias(f"c{c}") for c in "xyz"])
    there = there.join(parts, cells).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    inside = (F.col("s.x") == 0) & (F.col("s.y") == 0) & (F.col("s.z") == 0)
    near = g.dot(F.col("va"), F.col("vb")) >= math.cos(min(radius, math.pi)) - 1e-9
    met = here.join(there, [*cells, "part"]).filter(near & (~inside | (F.col("a") < F.col("b"))))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), g.angle(F.col("va"), F.col("vb")).alias("w")).filter(F.col("w") <= radius)


def within(points: DataFrame, radius: float, other: DataFrame | None = None, few: bool = False) -> DataFrame:
    """Pairs (a, b, w) at most ``radius`` radians apart: cells of the cube around the sphere, so poles and the date line are plain.

    ``few``: the others' cells are broadcast."""
    size = 2.0 * math.sin(min(radius, math.pi) / 2.0) + 1e-12
    here = points.select(F.col("k").alias("a"), F.col("v").alias("va"), *[cell(F.col(f"v.{c}"), size).alias(c) for c in "xyz"])
    there = (other if other is not None else points).select(F.col("k").alias("b"), F.col("v").alias("vb"), F.explode(cells_around(F.col("v.x"), size)).alias("x"), "v")
    there = there.select("*", F.explode(cells_around(F.col("v.y"), size)).alias("y")).select("*", F.explode(cells_around(F.col("v.z"), size)).alias("z")).drop("v")
    pairs = here.join(F.broadcast(there) if few else there, ["x", "y", "z"]).withColumn("w", g.angle(F.col("va"), F.col("vb"))).filter(F.col("w") <= radius)
    return (pairs.filter("a < b") if other is None else pairs).select("a", "b", "w")


def segment_pairs(left: DataFrame, right: DataFrame, size: float, size_x: float | None = None) -> DataFrame:
    """Pairs of segments whose boxes share a cell (``size`` high, ``size_x`` wide), each pair once: the cell that holds the upper-left
    corner of the boxes' common part."""
    size_x = size_x or size

    def spread(s, p):
        y0, y1, x0, x1 = F.least("ay", "by_"), F.greatest("ay", "by_"), F.least("ax", "bx"), F.greatest("ax", "bx")
        s = s.select("*", F.explode(cells_of(y0, y1, size)).alias("cy")).select("*", F.explode(cells_of(x0, x1, size_x)).alias("cx"))
        return s.select("cy", "cx", *[F.col(c).alias(f"{p}_{c}") for c in ("rid", "seq", "ay", "ax", "by_", "bx")])

    j = spread(left, "l").join(spread(right, "r"), ["cy", "cx"])
    low = lambda a, p: F.least(f"{p}_{a[0]}", f"{p}_{a[1]}")
    high = lambda a, p: F.greatest(f"{p}_{a[0]}", f"{p}_{a[1]}")
    ys, xs = ("ay", "by_"), ("ax", "bx")
    top, side = F.greatest(low(ys, "l"), low(ys, "r")), F.greatest(low(xs, "l"), low(xs, "r"))
    meet = (top <= F.least(high(ys, "l"), high(ys, "r"))) & (side <= F.least(high(xs, "l"), high(xs, "r")))
    return j.filter(meet & (F.col("cy") == cell(top, size)) & (F.col("cx") == cell(side, size_x))).drop("cy", "cx")
