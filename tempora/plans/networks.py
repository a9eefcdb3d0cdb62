"""Graph and proximity queries."""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions import geo as g
from tempora.operators import spatial as sp
from tempora.operators.graph import connected_components
from tempora.operators.rings import by_shape, cleaned, told
from tempora.plans import fixtures as fx
from tempora.plans.catalog import query
from tempora.plans.fixtures import with_
from tempora.plans.scratch import materialize
from tempora.plans.spatial import R300, neighbours, path_segments, points

C = F.col


@query("G1_connected_components", with_("edges").replace("WITH ", "WITH RECURSIVE ", 1)[:-1] + """, und AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
  reach AS (SELECT a n, a c FROM und UNION SELECT u.b, r.c FROM reach r JOIN und u ON u.a = r.n) SELECT n AS id, min(c) AS component FROM reach GROUP BY 1""")
def g1(spark, sf):
    return connected_components(fx.graph_edges(spark, sf)).select("id", "component")


@query("G2_bridge_chains")
def g2(spark, sf):
    """Shortest chains of connector edges between components, at most 12 edges: one row for each pair that meets."""
    parts = materialize(connected_components(fx.graph_edges(spark, sf)), "parts")
    k = C("c_custkey")
    ties = fx.table(spark, sf, "customer").select(k.alias("a"), (k + 1).alias("b"))
    return bridges(parts, ties.union(ties.select("b", "a")))


def bridges(parts: DataFrame, ties: DataFrame, most: int = 12) -> DataFrame:
    """c1, c2, hops: breadth-first from all components at once; a node belongs to the first component that reaches it."""
    seen = materialize(parts.select("id", "component", F.lit(0).alias("hops")), "seen")
    ties = materialize(ties.distinct(), "ties")
    for hop in range(1, most // 2 + 1):
        front = seen.filter(C("hops") == hop - 1).join(ties, C("id") == C("a")).groupBy(C("b").alias("id")).agg(F.min("component").alias("component"))
        new = materialize(front.join(seen.select("id"), "id", "left_anti").select("id", "component", F.lit(hop).alias("hops")), "front")
        if new.isEmpty():
            break
        seen = seen.union(new)
    other = seen.select(C("id").alias("b"), C("component").alias("c2"), C("hops").alias("h2"))
    meet = ties.join(seen.withColumnRenamed("id", "a"), "a").join(other, "b").filter("component < c2")
    return meet.groupBy(C("component").alias("c1"), "c2").agg(F.min(C("hops") + C("h2") + 1).alias("hops")).filter(C("hops") <= most)


@query("G3_colouring")
def g3(spark, sf):
    shapes, members = by_shape(fx.rings(spark, sf))
    return coloured_alike(members.select(C("rid").alias("id"), "shape"), neighbours(shapes).select("a", "b"))


def coloured(nodes: DataFrame, near: DataFrame, slots: int = 8) -> DataFrame:
    """id, slot: neighbours differ wherever a node has fewer neighbours than slots. ``near`` holds both directions."""
    return coloured_alike(nodes.select("id", C("id").alias("shape")), near, slots)


def coloured_alike(members: DataFrame, near: DataFrame, slots: int = 8) -> DataFrame:
    """(id, slot) of nodes (id, shape) that are neighbours where their shapes (a, b) are ``near``; a shape near itself has its nodes near
    each other.

    Nodes choose in turn (more neighbours first, then a hash, then id) among the slots that no neighbour before them has. Rounds colour
    every node that comes before all its uncoloured neighbours, and every one whose neighbours before it have all slots already: it can
    choose nothing, whatever the others take. A shape tells its neighbours no more than its first node of each slot.
    """
    near = materialize(near, "near")
    size = members.groupBy(C("shape").alias("b")).agg(F.count("*").alias("n"))
    degree = near.join(size, "b").groupBy(C("a").alias("shape")).agg((F.sum("n") - F.count_if(C("a") == C("b"))).alias("d"))
    rank = F.struct(-F.coalesce("d", F.lit(0)), F.xxhash64("id"), C("id")).alias("rank")
    left = materialize(members.join(degree, "shape", "left").select("id", "shape", rank), "left")
    firsts = left.select("shape", F.lit(0).alias("slot"), C("rank").alias("first")).limit(0)
    every, parts = F.array(*[F.lit(i) for i in range(slots)]), [left.select("id", F.lit(0).alias("slot")).limit(0)]
    todo = left.count()
    while todo:
        ahead = near.join(left.groupBy(C("shape").alias("b")).agg(F.min("rank").alias("rb")), "b").groupBy(C("a").alias("shape")).agg(F.min("rb").alias("rb"))
        taken = near.join(firsts.withColumnRenamed("shape", "b"), "b").groupBy(C("a").alias("shape"), "slot").agg(F.min("first").alias("first"))
        taken = taken.groupBy("shape").agg(F.collect_list(F.struct("slot", "first")).alias("taken"))
        now = left.join(ahead, "shape", "left").join(taken, "shape", "left")
        used = F.transform(F.filter("taken", lambda t: t["first"] < C("rank")), lambda t: t["slot"])
        now = now.withColumn("free", F.array_except(every, F.coalesce(used, F.array().cast("array<int>"))))
        # a node spreads over the free slots by its id; with none left it takes any
        slot = F.when(F.size("free") > 0, F.get("free", (F.pmod("id", F.size("free"))).cast("int"))).otherwise((F.pmod("id", F.lit(slots))).cast("int"))
        now = materialize(now.select("id", "shape", "rank", F.when(C("rb").isNull() | (C("rank") <= C("rb")) | (F.size("free") == 0), slot).alias("slot")), "now")
        settled, left = now.filter("slot IS NOT NULL"), now.filter("slot IS NULL").select("id", "shape", "rank")
        firsts = materialize(firsts.union(settled.select("shape", "slot", C("rank").alias("first"))).groupBy("shape", "slot").agg(F.min("first").alias("first")), "firsts")
        parts.append(settled.select("id", "slot"))
        if len(parts) > 20:  # keeps the plan short
            parts = [materialize(functools.reduce(DataFrame.union, parts), "done")]
        todo = _fewer(left, todo)
    return functools.reduce(DataFrame.union, parts)


def _fewer(left: DataFrame, before: int) -> int:
    """Rows left; rounds that settle nothing (a null key, a node beside itself) would never end."""
    n = left.count()
    if n >= before:
        raise ValueError(f"{n} rows can't be settled")
    return n


@query("W26_proximity_dedup")
def w26(spark, sf):
    """Points by rank (their key); a point goes if a kept, better one lies within 300 km. Rounds give the sequential answer."""
    return thinned(points(spark, sf).select("k", "v"), R300)


def thinned(pts: DataFrame, radius: float) -> DataFrame:
    """k of the points that stay; smaller k is better.

    In a cell no wider than the radius only the best open point can stay next, so rounds compare these few with what is open around them
    and never list the pairs of near points.
    """
    size = 2.0 * math.sin(min(radius, math.pi) / 2.0) / math.sqrt(3.0) * 0.999
    at = [sp.cell(C(f"v.{c}"), size).alias(f"c{c}") for c in "xyz"]
    open_ = materialize(pts.select("k", "v", *at), "open")
    kept = open_.select("k").limit(0)
    todo = open_.count()
    while todo:
        best = materialize(open_.groupBy("cx", "cy", "cz").agg(F.min_by("v", "k").alias("v"), F.min("k").alias("k")).select("k", "v"), "best")
        blocked = sp.within(open_, radius, best).filter("a < b").select(C("b").alias("k")).distinct()
        now = materialize(best.join(blocked, "k", "left_anti"), "now")
        gone = sp.within(open_, radius, now).select(C("a").alias("k")).union(now.select("k")).distinct()
        kept = materialize(kept.union(now.select("k")), "kept")
        open_ = materialize(open_.join(gone, "k", "left_anti"), "open")
        todo = _fewer(open_, todo)
    return kept


def _near_segments(pts: DataFrame, edges: DataFrame, size: float, margin: int) -> DataFrame:
    """(k, y, x) with the ring edges within a margin of it, planar distance d2 and position t along the edge."""
    boxes = edges.select("*", F.least("ay", "by_").alias("y0"), F.greatest("ay", "by_").alias("y1"), F.least("ax", "bx").alias("x0"), F.greatest("ax", "bx").alias("x1"))
    spread = boxes.select("*", F.explode(sp.cells_of(C("y0") - margin, C("y1") + margin, size)).alias("cy")).select("*", F.explode(sp.cells_of(C("x0") - margin, C("x1") + margin, size)).alias("cx"))
    j = pts.withColumn("cy", sp.cell(C("y"), size)).withColumn("cx", sp.cell(C("x"), size)).join(spread, ["cy", "cx"])
    px, py, ex, ey = ((C(a) - C(b)).cast("double") for a, b in (("x", "ax"), ("y", "ay"), ("bx", "ax"), ("by_", "ay")))
    t = g.clamp((px * ex + py * ey) / (ex * ex + ey * ey), 0.0, 1.0)
    j = j.withColumn("t", t)
    d2 = (px - C("t") * ex) * (px - C("t") * ex) + (py - C("t") * ey) * (py - C("t") * ey)
    return j.withColumn("d2", d2).filter(C("d2") <= float(margin) ** 2)


def _first_edges(edges: DataFrame) -> DataFrame:
    """Of edges that lie alike, in one direction, the least by ring and place: the nearest edge's choice among them."""
    return edges.groupBy("ay", "ax", "by_", "bx").agg(F.min(F.struct("rid", "seq")).alias("m")).select("m.rid", "m.seq", "ay", "ax", "by_", "bx")


@query("J9_nearest_segment_snap")
def j9(spark, sf):
    near = _near_segments(fx.pip(spark, sf), _first_edges(sp.ring_edges(fx.rings(spark, sf))), 1e6, 200000)
    best = near.groupBy("k").agg(F.min(F.struct("d2", "rid", "seq", "t", "ay", "ax", "by_", "bx")).alias("m"))
    return best.select("k", "m.rid", "m.seq", (C("m.ay") + C("m.t") * (C("m.by_") - C("m.ay"))).cast("long").alias("y"), (C("m.ax") + C("m.t") * (C("m.bx") - C("m.ax"))).cast("long").alias("x"))


@query("J9_snap_with_splice")
def j9_rings(spark, sf):
    """Every ring, moved a little, snapped onto the rings: its vertices project, the target's vertices between them are spliced in."""
    r = fx.rings(spark, sf)
    moved = r.select(C("rid").alias("path"), "seq", (C("qlat") + 30000).alias("y"), (C("qlon") + 7000).alias("x"))
    return snapped(moved, r, 1e6, 200000).select("path", "place", F.round("y", 1).alias("y"), F.round("x", 1).alias("x"))


def snapped(paths: DataFrame, rings: DataFrame, size: float, margin: int, most: int = 60) -> DataFrame:
    """(path, place, y, x): closed paths (path, seq, y, x) whose points within ``margin`` of a ring go onto it.

    Between neighbours on one ring its own vertices are spliced in, the short way round unless that has more than ``most`` of them.
    Ring vertices are numbered from 0 without gaps.
    """
    pts = paths.select(F.struct("path", "seq").alias("k"), "y", "x")
    near = _near_segments(pts, _first_edges(sp.ring_edges(rings)), size, margin)
    on = near.groupBy("k").agg(F.min(F.struct("d2", "rid", "seq", "t", "ay", "ax", "by_", "bx")).alias("m"))
    sizes = rings.groupBy("rid").agg(F.count("*").alias("size"))
    rows = pts.join(on, "k", "left").select("k.path", "k.seq", C("m.rid").alias("rid"), (C("m.seq") + C("m.t")).alias("s"), "y", "x",
                                            (C("m.ay") + C("m.t") * (C("m.by_") - C("m.ay"))).alias("sy"), (C("m.ax") + C("m.t") * (C("m.bx") - C("m.ax"))).alias("sx"))
    w = Window.partitionBy("path").orderBy("seq")
    here = F.struct("rid", "s")
    nxt = F.coalesce(F.lead(here).over(w), F.first(here).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rows = materialize(rows.withColumn("nxt", nxt), "snapped")
    own = rows.select("path", "seq", F.lit(0).alias("part"), F.coalesce("sy", C("y").cast("double")).alias("y"), F.coalesce("sx", C("x").cast("double")).alias("x"))
    walk = rows.filter("rid = nxt.rid").join(sizes, "rid").withColumn("ahead", F.pmod(C("nxt.s") - C("s"), C("size").cast("double"))).withColumn("back", F.pmod(C("s") - C("nxt.s"), C("size").cast("double")))
    forth = (C("ahead") <= C("back")) & (C("ahead") <= most)
    aback = (C("ahead") > C("back")) & (C("back") <= most)
    first, last = F.floor("s") + 1, F.ceil(C("s") + C("ahead")) - 1
    high, low = F.ceil("s") - 1, F.floor(C("s") - C("back")) + 1
    at = F.when(forth & (last >= first), F.sequence(first, F.greatest(first, last))).when(aback & (high >= low), F.sequence(F.greatest(high, low), low))
    walk = walk.select("path", "seq", "rid", "size", F.posexplode(at).alias("part", "n"))
    vertices = rings.select("rid", C("seq").alias("n"), C("qlat").cast("double").alias("y"), C("qlon").cast("double").alias("x"))
    between = walk.withColumn("n", F.pmod("n", "size")).join(vertices, ["rid", "n"]).select("path", "seq", (C("part") + 1).alias("part"), "y", "x")
    every = own.union(between).withColumn("seq", F.row_number().over(Window.partitionBy("path").orderBy("seq", "part")))
    return cleaned(every, "path", ["y", "x"]).select("path", F.row_number().over(w).alias("place"), "y", "x")


@query("J13_node_on_segment")
def j13(spark, sf):
    """Ring edges cut at every point within 20,000 units of them, in order along the edge."""
    shapes, members = by_shape(fx.rings(spark, sf))
    near = _near_segments(fx.pip(spark, sf), sp.ring_edges(shapes), 1e6, 20000)
    w = Window.partitionBy("rid", "seq").orderBy("t", "k")
    parts = near.select("rid", "seq", F.row_number().over(w).cast("long").alias("part"), "k", F.round("t", 6).alias("t"))
    return told(parts, members, "rid").select("rid", "seq", "part", "k", "t")


@query("J14_clip_against_water")
def j14(spark, sf):
    """Runs of the points of a path (100 keys each) that lie outside all rings."""
    wet = sp.points_in_rings(fx.pip(spark, sf), by_shape(fx.rings(spark, sf))[0]).select("k").distinct().withColumn("wet", F.lit(1))
    p = fx.pip(spark, sf).join(wet, "k", "left").select(F.floor(C("k") / 100).alias("path"), "k", F.coalesce("wet", F.lit(0)).alias("wet"))
    w = Window.partitionBy("path").orderBy("k")
    runs = p.withColumn("run", F.sum((F.coalesce(F.lag("wet").over(w), F.lit(-1)) != C("wet")).cast("int")).over(w))
    return runs.filter("wet = 0").groupBy("path", "run").agg(F.min("k").alias("first_"), F.max("k").alias("last_"), F.count("*").alias("n"))


@query("J14_shoreline_points")
def j14_points(spark, sf):
    """The same runs as points, each with the crossings of the shore at its ends."""
    p = fx.pip(spark, sf).select(F.floor(C("k") / 100).alias("path"), "k", "y", "x")
    return outside_runs(p, fx.rings(spark, sf), 4e6).select("path", "run", "place", F.round("y", 1).alias("y"), F.round("x", 1).alias("x"))


def outside_runs(points: DataFrame, rings: DataFrame, leg: float) -> DataFrame:
    """(path, run, place, y, x): runs of the points (path, k, y, x) outside all rings; where the path goes on inside, the run ends at the
    first crossing of a shore. ``leg``: cells for legs of the paths."""
    rings = by_shape(rings)[0]  # a second ring that lies alike changes neither what is wet nor where the shore is
    wet = sp.points_in_rings(points.select("k", "y", "x"), rings).select("k").distinct().withColumn("wet", F.lit(1))
    w = Window.partitionBy("path").orderBy("k")
    state = F.struct("wet", "y", "x")
    p = points.join(wet, "k", "left").withColumn("wet", F.coalesce("wet", F.lit(0))).withColumn("before", F.lag(state).over(w)).withColumn("after", F.lead(state).over(w))
    p = p.withColumn("run", F.sum((F.coalesce("before.wet", F.lit(-1)) != C("wet")).cast("int")).over(w))
    dry = materialize(p.filter("wet = 0"), "dry")
    legs = dry.filter("before.wet = 1").select("k", F.lit(-1).alias("side"), "y", "x", C("before.y").alias("oy"), C("before.x").alias("ox")).union(
        dry.filter("after.wet = 1").select("k", F.lit(1), "y", "x", "after.y", "after.x"))
    legs = legs.select(C("k").alias("rid"), C("side").alias("seq"), C("y").alias("ay"), C("x").alias("ax"), C("oy").alias("by_"), C("ox").alias("bx"))
    c = lambda n: C(n).cast("double")
    pairs = sp.segment_pairs(legs, sp.ring_edges(rings), leg)
    dy, dx, ey, ex = c("l_by_") - c("l_ay"), c("l_bx") - c("l_ax"), c("r_by_") - c("r_ay"), c("r_bx") - c("r_ax")
    det = F.nullif(dx * ey - dy * ex, F.lit(0.0))
    pairs = pairs.withColumn("t", ((c("r_ax") - c("l_ax")) * ey - (c("r_ay") - c("l_ay")) * ex) / det).withColumn("u", ((c("r_ax") - c("l_ax")) * dy - (c("r_ay") - c("l_ay")) * dx) / det)
    shore = pairs.filter(C("t").between(0, 1) & C("u").between(-1e-12, 1 + 1e-12)).groupBy("l_rid", "l_seq").agg(F.min("t").alias("t"))
    ends = legs.join(shore, (C("rid") == C("l_rid")) & (C("seq") == C("l_seq"))).select(
        C("rid").alias("k"), C("seq").alias("side"), (C("ay") + C("t") * (C("by_") - C("ay"))).alias("y"), (C("ax") + C("t") * (C("bx") - C("ax"))).alias("x"))
    own = dry.select("path", "run", "k", F.lit(0).alias("side"), c("y").alias("y"), c("x").alias("x"))
    every = own.unionByName(ends.join(dry.select("k", "path", "run"), "k"))
    return every.select("path", "run", F.row_number().over(Window.partitionBy("path", "run").orderBy("k", "side")).alias("place"), "y", "x")


@query("J21_edges_on_river")
def j21(spark, sf):
    """Path segments whose midpoint lies within 0.01 radians of another path, as river edges."""
    s = path_segments(spark, sf)
    mids = s.select(F.struct("id", "seq").alias("k"), g.slerp(C("v"), C("n"), F.lit(0.5)).alias("v")).filter("v IS NOT NULL")
    return beside_others(mids, s.select(F.struct("id", "seq").alias("k"), "v", "n"), 0.01).select("k.id", "k.seq", F.lit(True).alias("on_river"))


FEW = 10_000  # points whose cells are broadcast


def beside_others(pts: DataFrame, arcs: DataFrame, radius: float) -> DataFrame:
    """k (struct id, seq) of the points (k, v) within ``radius`` of an arc (k, v, n) of another id, in time linear in both.

    Samples of arcs fall into cells no wider than the radius, and a cell keeps two ids at most: a point whose cell holds another id's sample
    is near it. Only points that their cell doesn't settle meet arcs one by one; where those are many, few arcs lie around each.
    """
    size = 2.0 * math.sin(radius / 2.0) / math.sqrt(3.0) * 0.999
    at = lambda v: [sp.cell(C(v + c), size).alias(f"c{c}") for c in "xyz"]
    pts, arcs = materialize(pts, "points"), materialize(arcs, "arcs")
    told = _arc_samples(arcs, radius).select(C("k.id").alias("id"), *at("")).groupBy("cx", "cy", "cz").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    sure = F.coalesce((C("lo") != C("k.id")) | (C("hi") != C("k.id")), F.lit(False)).alias("sure")
    seen = materialize(pts.select("k", "v", *at("v.")).join(told, ["cx", "cy", "cz"], "left").select("k", "v", sure), "beside")
    rest = seen.filter("NOT sure").select("k", "v")
    open_ = rest.count()
    near = near_arcs(rest, arcs, radius, few=open_ <= FEW).filter("a.id <> b.id").select("a.*").distinct() if open_ else None
    done = seen.filter("sure").select("k")
    return done if near is None else done.union(near.select(F.struct("id", "seq").alias("k")))


def _arc_samples(arcs: DataFrame, step: float) -> DataFrame:
    """(k, x, y, z): points of arcs (k, v, n) at most ``step`` radians apart, ends included; none of arcs between antipodes."""
    parts = int(arcs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small rows that grow: they need their tasks before that
    flat = [C(f"{v}.{c}").alias(f"{v}{c}") for v in "vn" for c in "xyz"]
    w = arcs.select("k", *flat, g.angle(C("v"), C("n")).alias("w")).repartition(parts, "k").withColumn("s", F.sin("w")).filter("w < 1e-12 OR abs(s) > 1e-12")
    i = w.withColumn("steps", F.greatest(F.lit(1), F.ceil(C("w") / step).cast("int"))).select("*", F.explode(F.sequence(F.lit(0), C("steps"))).alias("i")).withColumn("t", C("i") / C("steps"))
    part = lambda u, whole: F.when(C("w") < 1e-12, whole).otherwise(F.sin(u * C("w")) / C("s"))
    i = i.withColumn("a", part(1.0 - C("t"), 1.0)).withColumn("b", part(C("t"), 0.0))  # plain columns: structs would be built for each of their parts
    return i.select("k", *[(C(f"v{c}") * C("a") + C(f"n{c}") * C("b")).alias(c) for c in "xyz"])


def near_arcs(pts: DataFrame, arcs: DataFrame, radius: float, few: bool = False) -> DataFrame:
    """(a, b): points (k, v) within ``radius`` of arcs (k, v, n). Arcs are met at samples one radius apart, then measured. ``few``
    points go to the samples instead of being shuffled with them."""
    samples = _arc_samples(arcs, radius).select("k", F.struct("x", "y", "z").alias("v"))
    met = sp.within(samples, radius * 1.2, pts, few=few).select(C("b").alias("a"), C("a").alias("b")).distinct()  # points are the fewer ones to spread
    met = materialize(met, "met").join(pts.select(C("k").alias("a"), C("v").alias("p")), "a").join(arcs.select(C("k").alias("b"), "v", "n"), "b")
    return met.filter(g.to_arc(C("p"), C("v"), C("n")) <= radius).select("a", "b")


@query("J22_watershed")
def j22(spark, sf):
    """Networks of 50 keys: drained where a point lies in water or an end lies within the mouth gap of a shore."""
    pts = fx.pip(spark, sf)
    edges = sp.ring_edges(fx.rings(spark, sf))
    wet = sp.points_in_rings(pts, fx.rings(spark, sf)).select("k").distinct().withColumn("wet", F.lit(True))
    shore = _near_segments(pts, _first_edges(edges), 1e6, 500000).groupBy("k").agg(F.sqrt(F.min("d2")).alias("gap"))
    net = pts.withColumn("net", F.floor(C("k") / 50)).join(wet, "k", "left").join(shore, "k", "left")
    ends = F.min("k").over(Window.partitionBy("net")), F.max("k").over(Window.partitionBy("net"))
    net = net.withColumn("mouth", ((C("k") == ends[0]) | (C("k") == ends[1])) & (C("gap") <= 100000))
    return net.groupBy("net").agg(F.bool_or(F.coalesce("wet", F.lit(False)) | F.coalesce("mouth", F.lit(False))).alias("drains"), F.round(F.min("gap"), 1).alias("nearest"))


@query("W23_label_anchor")
def w23(spark, sf):
    """Pole of inaccessibility of each ring: a coarse grid, then refinements around the best point so far."""
    r, members = by_shape(fx.rings(spark, sf))
    edges = materialize(sp.ring_edges(r), "edges")
    box = sp.ring_boxes(r).select("rid", ((C("y0") + C("y1")) / 2).alias("cy"), ((C("x0") + C("x1")) / 2).alias("cx"), (C("y1") - C("y0")).cast("double").alias("h"), (C("x1") - C("x0")).cast("double").alias("w"))
    best = box
    for n in (24, 5, 5, 5, 5, 5):  # the coarse grid and its refinements
        steps = F.sequence(F.lit(0), F.lit(n - 1))
        cand = best.select("*", F.explode(steps).alias("i")).select("*", F.explode(steps).alias("j"))
        cand = cand.select("rid", "h", "w", (C("cy") + (C("i") / (n - 1.0) - 0.5) * C("h")).alias("y"), (C("cx") + (C("j") / (n - 1.0) - 0.5) * C("w")).alias("x"))
        j = cand.join(edges, "rid")
        px, py, ex, ey = C("x") - C("ax"), C("y") - C("ay"), (C("bx") - C("ax")).cast("double"), (C("by_") - C("ay")).cast("double")
        t = g.clamp((px * ex + py * ey) / (ex * ex + ey * ey), 0.0, 1.0)
        d = F.sqrt((px - t * ex) * (px - t * ex) + (py - t * ey) * (py - t * ey))
        level = (C("ay") > C("y")) == (C("by_") > C("y"))
        ray = F.when(level, F.lit(False)).otherwise(C("x") < ex * (C("y") - C("ay")) / F.when(ey == 0, F.lit(1.0)).otherwise(ey) + C("ax"))
        got = j.groupBy("rid", "h", "w", "y", "x").agg(F.min(d).alias("d"), (F.count_if(ray) % 2 == 1).alias("inside"))
        score = F.struct(F.when(C("inside"), C("d")).otherwise(-C("d")).alias("s"), (-C("y")).alias("ny"), (-C("x")).alias("nx"))
        top = got.groupBy("rid").agg(F.max(score).alias("m"), F.first("h").alias("h"), F.first("w").alias("w"))
        best = materialize(top.select("rid", (-C("m.ny")).alias("cy"), (-C("m.nx")).alias("cx"), (C("h") * (2.0 / (n - 1))).alias("h"), (C("w") * (2.0 / (n - 1))).alias("w"), C("m.s").alias("s")), "best")
    return told(best, members, "rid").select("rid", F.round("cy", 1).alias("y"), F.round("cx", 1).alias("x"), F.round("s", 1).alias("room"))


@query("W27_iso_band", with_("grid") + """, b AS (SELECT DISTINCT v // 100 band FROM grid), m AS (SELECT list(band ORDER BY band) l FROM b), p AS (SELECT l[(len(l)+1)//2] band FROM m),
  n AS (SELECT g.i, g.j, min(abs(g.i-h.i) + abs(g.j-h.j)) gap FROM grid g JOIN p ON g.v // 100 = p.band JOIN grid h ON h.v // 100 = p.band + 1 GROUP BY 1, 2) SELECT max(gap) AS budget, count(*) AS n FROM n""")
def w27(spark, sf):
    """The middle band of the grid and the largest gap from it to the next band: the snap budget."""
    gr = fx.grid(spark, sf).withColumn("band", F.floor(C("v") / 100))
    bands = gr.agg(F.array_sort(F.collect_set("band")).alias("l")).select(F.get("l", (F.floor((F.size("l") + 1) / 2) - 1).cast("int")).alias("mid"))  # ten bands
    here = gr.join(F.broadcast(bands), C("band") == C("mid")).select("i", "j")
    there = gr.join(F.broadcast(bands), C("band") == C("mid") + 1).select(C("i").alias("hi"), C("j").alias("hj"))
    return gaps(here, there).agg(F.max("gap").alias("budget"), F.count("*").alias("n"))


def gaps(here: DataFrame, there: DataFrame, first: int = 8) -> DataFrame:
    """i, j, gap: the least |i - hi| + |j - hj|, by cells whose size doubles for those that have found nothing yet."""
    left, there = materialize(here, "left"), materialize(there, "there")
    done = left.select("i", "j", F.lit(0).cast("long").alias("gap")).limit(0)
    if there.isEmpty():
        return done
    size = float(first)
    while not left.isEmpty():
        cells = left.select("i", "j", F.explode(sp.cells_around(C("i"), size)).alias("ci")).select("*", F.explode(sp.cells_around(C("j"), size)).alias("cj"))
        at = there.select("hi", "hj", sp.cell(C("hi"), size).alias("ci"), sp.cell(C("hj"), size).alias("cj"))
        gap = F.abs(C("i") - C("hi")) + F.abs(C("j") - C("hj"))
        near = materialize(cells.join(at, ["ci", "cj"]).groupBy("i", "j").agg(F.min(gap).alias("gap")).filter(C("gap") <= size), "near")
        done, left, size = done.union(near), materialize(left.join(near, ["i", "j"], "left_anti"), "left"), size * 2
    return done
