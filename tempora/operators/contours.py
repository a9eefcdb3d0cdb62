"""Contours of a grid: directed segments of marching squares, chained into rings by list ranking.

Joins of the rounds are merged: each would broadcast a side below the session's limit anew, and the driver would gather one a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.operators.overlay import cycles
from tempora.plans.scratch import materialize

OUTSIDE = -30000.0  # the value of what the grid lacks: below every level, so contours close along its edge
C = F.col


def contour_segments(grid: DataFrame, level: float) -> DataFrame:
    """h, nxt (struct i, j, level_side: a grid side by its lower left end, lying or upright) and y, x (where the level crosses ``h``).

    Segments run with what is at or above the level on their right (j to the right, i up). Round a cell, counter-clockwise, a segment comes in where the
    ground rises over the level and goes out at the next side where it falls, or at the side before where a saddle's middle is high.
    """
    corner = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in enumerate(((0, 0), (0, 1), (1, 1), (1, 0)))]))
    cells = grid.select("i", "j", C("v").cast("double").alias("v"), corner.alias("c")).groupBy((C("i") - C("c.a")).alias("i"), (C("j") - C("c.b")).alias("j"))
    cells = cells.agg(F.array(*[F.coalesce(F.max(F.when(C("c.k") == k, C("v"))), F.lit(OUTSIDE)) for k in range(4)]).alias("v"))
    up = lambda k: F.get("v", F.pmod(k, F.lit(4))) >= level
    falls = lambda k: up(k) & ~up(k + 1)
    around = F.sequence(F.lit(0), F.lit(3))
    into = cells.withColumn("r", F.explode(F.filter(around, lambda k: ~up(k) & up(k + 1))))
    high = (up(F.lit(0)) == up(F.lit(2))) & (up(F.lit(1)) == up(F.lit(3))) & (F.aggregate("v", F.lit(0.0), lambda s, v: s + v) / 4 >= level)
    turns = F.when(high, F.array(*[C("r") + d for d in (3, 2, 1)])).otherwise(F.array(*[C("r") + d for d in (1, 2, 3)]))
    into = into.withColumn("t", F.pmod(F.get(F.filter(turns, falls), F.lit(0)), F.lit(4)))
    side = lambda k: F.struct((C("i") + (k == 2).cast("int")).alias("i"), (C("j") + (k == 1).cast("int")).alias("j"), (k % 2 == 0).alias("level_side"))
    # the ends of a side from below or left: 0 runs from corner 0 to 1, 1 from 1 to 2, 2 from 3 to 2, 3 from 0 to 3
    first, last = F.get(F.array(*map(F.lit, (0, 1, 3, 0))), C("r")), F.get(F.array(*map(F.lit, (1, 2, 2, 3))), C("r"))
    a, b = F.get("v", first), F.get("v", last)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(level) - a) / (b - a)))
    h = side(C("r"))
    return into.select(h.alias("h"), side(C("t")).alias("nxt"), (h["i"] + F.when(h["level_side"], 0.0).otherwise(t)).alias("y"), (h["j"] + F.when(h["level_side"], t).otherwise(0.0)).alias("x"))


def closed(successors: DataFrame) -> DataFrame:
    """The rows (h, nxt) of chains that close. Ends of open chains spread backwards, doubling their reach, until a round finds none."""
    state = materialize(successors.select("h", "nxt", F.lit(False).alias("over")), "chains")
    ended = 0
    while True:
        ahead = state.select(C("h").alias("nxt"), C("nxt").alias("nn"), C("over").alias("after"))
        new = state.join(ahead.hint("merge"), "nxt", "left").select("h", F.when(~C("over"), C("nn")).alias("nxt"), (C("over") | C("after").isNull() | C("after")).alias("over"))
        state = materialize(new, "chains")
        now = state.filter("over").count()
        if now == ended:
            break
        ended = now
    return successors.join(state.filter("NOT over").select("h").hint("merge"), "h")


def ranked(successors: DataFrame) -> DataFrame:
    """(h, cycle, place, size): the place of each member of a cycle after its least one, which is 0, by doubling."""
    told = materialize(successors.select("h", "nxt").join(cycles(successors).hint("merge"), "h"), "cycles")
    state = told.select("h", F.when(C("nxt") != C("cycle"), C("nxt")).alias("nxt"), F.when(C("nxt") != C("cycle"), 1).otherwise(0).cast("long").alias("left"))
    state = materialize(state, "ranks")
    while not state.filter("nxt IS NOT NULL").isEmpty():
        ahead = state.select(C("h").alias("nxt"), C("nxt").alias("nn"), C("left").alias("more"))
        state = materialize(state.join(ahead.hint("merge"), "nxt", "left").select("h", C("nn").alias("nxt"), (C("left") + F.coalesce("more", F.lit(0))).alias("left")), "ranks")
    size = told.groupBy("cycle").agg(F.count("*").alias("size"))
    return told.select("h", "cycle").join(state.select("h", "left").hint("merge"), "h").join(size.hint("merge"), "cycle").select("h", "cycle", (C("size") - 1 - C("left")).alias("place"), "size")


def contour_rings(grid: DataFrame, level: float, least: int = 8) -> DataFrame:
    """ring (its least side), place, y, x of the closed contours of ``least`` points or more; chains that don't close are left out."""
    segments = materialize(contour_segments(grid, level), "segments")
    rings = ranked(closed(segments.select("h", "nxt"))).filter(C("size") >= least)
    return rings.join(segments.select("h", "y", "x").hint("merge"), "h").select(C("cycle").alias("ring"), "place", "y", "x")
