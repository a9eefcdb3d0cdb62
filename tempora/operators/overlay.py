"""Planar overlay of ring layers on quantised coordinates: node, split, trace faces, classify, heal, absorb, dissolve.

Segments are rows (wid, ay, ax, by_, bx) of integer coordinates. Each step is a join or an aggregate on cells, vertices or edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.operators import spatial as sp
from tempora.operators.edgecells import edge_cells, points_in_cells
from tempora.plans.scratch import materialize


def split_at_nodes(segments: DataFrame, size: float, size_x: float | None = None) -> DataFrame:
    """Undirected edges (uy, ux, vy, vx, witnesses) after cutting every segment where another crosses or touches it.

    Segments that lie alike are cut alike, so they are cut once, under the least of them, and their witnesses come back with its parts.
    """
    least = F.min(F.struct(F.col("wid").alias("rid"), F.col("sid").alias("seq"))).alias("m")
    alike = materialize(segments.groupBy("ay", "ax", "by_", "bx").agg(least, F.collect_set("wid").alias("wids")).select("m.rid", "m.seq", "ay", "ax", "by_", "bx", "wids"), "alike")
    s = alike.drop("wids")
    p = sp.segment_pairs(s, s, size, size_x).filter("l_rid <> r_rid OR l_seq <> r_seq")
    c = lambda n: F.col(n).cast("double")
    dx, dy, ex, ey = c("l_bx") - c("l_ax"), c("l_by_") - c("l_ay"), c("r_bx") - c("r_ax"), c("r_by_") - c("r_ay")
    det = dx * ey - dy * ex
    safe = F.when(det == 0, F.lit(1.0)).otherwise(det)
    t = ((c("r_ax") - c("l_ax")) * ey - (c("r_ay") - c("l_ay")) * ex) / safe
    u = ((c("r_ax") - c("l_ax")) * dy - (c("r_ay") - c("l_ay")) * dx) / safe
    on = lambda v: (v >= -1e-9) & (v <= 1 + 1e-9)
    cross = F.when((det != 0) & on(t) & on(u), F.struct(F.round(c("l_ay") + t * dy).cast("long").alias("y"), F.round(c("l_ax") + t * dx).cast("long").alias("x")))
    # of parallel segments on one line: ends of the one that lie on the other
    end = lambda y, x: F.when((det == 0) & ((c(x) - c("l_ax")) * dy - (c(y) - c("l_ay")) * dx == 0)
                              & c(y).between(F.least("l_ay", "l_by_"), F.greatest("l_ay", "l_by_")) & c(x).between(F.least("l_ax", "l_bx"), F.greatest("l_ax", "l_bx")),
                              F.struct(F.col(y).alias("y"), F.col(x).alias("x")))
    nodes = p.select(F.col("l_rid").alias("rid"), F.col("l_seq").alias("seq"), F.explode(F.array(cross, end("r_ay", "r_ax"), end("r_by_", "r_bx"))).alias("n")).filter("n IS NOT NULL")
    own = s.select("rid", "seq", F.explode(F.array(F.struct(F.col("ay").alias("y"), F.col("ax").alias("x")), F.struct(F.col("by_").alias("y"), F.col("bx").alias("x")))).alias("n"))
    every = nodes.union(own).distinct().join(s, ["rid", "seq"])
    along = (F.col("n.y") - F.col("ay")) * (F.col("by_") - F.col("ay")).cast("double") + (F.col("n.x") - F.col("ax")) * (F.col("bx") - F.col("ax")).cast("double")
    w = Window.partitionBy("rid", "seq").orderBy("along", "n.y", "n.x")
    parts = every.withColumn("along", along).withColumn("m", F.lead("n").over(w)).filter("m IS NOT NULL AND m <> n")
    lo, hi = F.least("n", "m"), F.greatest("n", "m")
    parts = parts.select("rid", "seq", lo.alias("u"), hi.alias("v")).join(alike.select("rid", "seq", "wids"), ["rid", "seq"])
    return parts.groupBy("u", "v").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("wids")))).alias("witnesses")).select(
        F.col("u.y").alias("uy"), F.col("u.x").alias("ux"), F.col("v.y").alias("vy"), F.col("v.x").alias("vx"), "witnesses")


def half_edges(edges: DataFrame) -> DataFrame:
    """Both directions of every edge (oy, ox, dy, dx) with ``nxt``, the next half edge around the face on the left."""
    both = edges.select(F.col("uy").alias("oy"), F.col("ux").alias("ox"), F.col("vy").alias("dy"), F.col("vx").alias("dx")).union(edges.select("vy", "vx", "uy", "ux"))
    turn = F.atan2((F.col("dy") - F.col("oy")).cast("double"), (F.col("dx") - F.col("ox")).cast("double"))
    w = Window.partitionBy("oy", "ox").orderBy("turn")
    # clockwise neighbour at the origin: the one before in turning order, cyclically
    around = both.withColumn("turn", turn).withColumn("before", F.coalesce(
        F.lag(F.struct("oy", "ox", "dy", "dx")).over(w),
        F.last(F.struct("oy", "ox", "dy", "dx")).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    # arriving at d from o, leave by the clockwise neighbour of the twin d -> o
    return around.select(F.struct(F.col("dy").alias("oy"), F.col("dx").alias("ox"), F.col("oy").alias("dy"), F.col("ox").alias("dx")).alias("h"), F.col("before").alias("nxt"))


def cycles(successors: DataFrame) -> DataFrame:
    """(h, cycle): the least member of each cycle of a permutation (h, nxt), by pointer doubling in log2(longest) rounds."""
    state = materialize(successors.select("h", "nxt", F.least("h", "nxt").alias("low")), "cycle")
    while True:  # least members only fall, so this ends
        ahead = state.select(F.col("h").alias("nxt"), F.col("nxt").alias("nn"), F.col("low").alias("nlow"))
        new = materialize(state.join(ahead.hint("merge"), "nxt").select("h", F.col("nn").alias("nxt"), F.least("low", "nlow").alias("low"), (F.col("nlow") < F.col("low")).alias("moved")), "cycle")
        state = new.select("h", "nxt", "low")
        if new.filter("moved").isEmpty():
            break
    return state.select("h", F.col("low").alias("cycle"))


def face_table(traced: DataFrame) -> DataFrame:
    """face, area (positive: a bounded face; negative: an outer boundary), n, and a point just inside its longest edge."""
    h = lambda c: F.col(f"h.{c}").cast("double")
    length = F.hypot(h("dy") - h("oy"), h("dx") - h("ox"))
    point = F.struct(length.alias("l"), ((h("oy") + h("dy")) / 2 + (h("dx") - h("ox")) / length / 4).alias("y"),
                     ((h("ox") + h("dx")) / 2 - (h("dy") - h("oy")) / length / 4).alias("x"))
    return traced.groupBy(F.col("cycle").alias("face")).agg(
        (F.sum(h("ox") * h("dy") - h("dx") * h("oy")) / 2).alias("area"), F.count("*").alias("n"), F.max(point).alias("p")).select("face", "area", "n", "p.y", "p.x")


def innermost(points: DataFrame, traced: DataFrame) -> DataFrame:
    """(k, face): the least bounded cycle around each point (k, y, x), which is the outer boundary of the face that holds it."""
    area = face_table(traced).filter("area > 0").select(F.col("face").alias("rid"), "area")
    edges = traced.select(F.col("cycle").alias("rid"), F.col("h.oy").alias("ay"), F.col("h.ox").alias("ax"), F.col("h.dy").alias("by_"), F.col("h.dx").alias("bx")).join(area, "rid")
    around = points_in_cells(points.select("k", "y", "x"), edge_cells(edges.drop("area")))
    return around.join(area, "rid").groupBy("k").agg(F.min(F.struct("area", "rid")).alias("m")).select("k", F.col("m.rid").alias("face"))


def located(traced: DataFrame) -> DataFrame:
    """(h, cycle) with the face of each half edge in place of its cycle: a bounded cycle names its face, the outer boundary of an
    enclosed part belongs to the face around it, and null is the outside."""
    cycles_ = face_table(traced)
    holes = innermost(cycles_.filter("area <= 0").select(F.col("face").alias("k"), "y", "x"), traced)
    own = cycles_.filter("area > 0").select(F.col("face").alias("k"), "face").union(holes.select("k", "face"))
    return traced.withColumnRenamed("cycle", "k").join(own, "k", "left").select("h", F.col("face").alias("cycle"))


def bounded_faces(sides: DataFrame, traced: DataFrame) -> DataFrame:
    """face, area (without what it encloses), n (edges on all its boundaries), y, x (a point inside)."""
    h = lambda c: F.col(f"h.{c}").cast("double")
    area = sides.filter("cycle IS NOT NULL").groupBy(F.col("cycle").alias("face")).agg((F.sum(h("ox") * h("dy") - h("dx") * h("oy")) / 2).alias("area"), F.count("*").alias("n"))
    return area.join(face_table(traced).filter("area > 0").select("face", "y", "x"), "face")


def claims(faces: DataFrame, rings: DataFrame) -> DataFrame:
    """(face, rid): the rings that hold each bounded face."""
    pts = faces.filter("area > 0").select(F.col("face").alias("k"), "y", "x")
    return sp.points_in_rings(pts, rings).withColumnRenamed("k", "face")


def first_of_equal(rings: DataFrame) -> DataFrame:
    """The rings (rid, seq, qlat, qlon) without those whose vertices are, in order, those of a ring of lesser rid.

    They hold the same faces and are of one size, so they own nothing where claims have neither rank nor parent. Vertices are numbered
    anew from 0: they come from the shapes, so the rings themselves are shuffled once.
    """
    item = F.struct("seq", "qlat", "qlon")
    shapes = rings.groupBy("rid").agg(F.transform(F.array_sort(F.collect_list(item)), lambda v: F.struct(v["qlat"].alias("qlat"), v["qlon"].alias("qlon"))).alias("vs"))
    first = shapes.groupBy("vs").agg(F.min("rid").alias("rid")).select("rid", F.posexplode("vs").alias("seq", "v"))
    return first.select("rid", F.col("seq").cast("long").alias("seq"), "v.qlat", "v.qlon")


def ring_sizes(rings: DataFrame) -> DataFrame:
    """rid, size: planar areas."""
    return sp.ring_edges(rings).groupBy("rid").agg((F.abs(F.sum(F.col("ax").cast("double") * F.col("by_") - F.col("bx").cast("double") * F.col("ay"))) / 2).alias("size"))


def owned(claimed: DataFrame, sizes: DataFrame, witnesses: DataFrame | None = None) -> DataFrame:
    """(face, rid): the claim that names each face: lowest rank first, then the deepest in its chain of parents, the least ring (by
    ``sizes``: rid, size), the least id.

    ``witnesses`` (rid, rank, parent) may leave rings out (rank 0, no parent). A claim counts only where its parent's counts.
    """
    told = claimed.select("face", "rid").join(sizes.select("rid", "size"), "rid")
    if witnesses is None:
        told = told.withColumn("rank", F.lit(0)).withColumn("depth", F.lit(0))
    else:
        told = materialize(told.join(_deep(witnesses), "rid", "left").select("face", "rid", "size", F.coalesce("rank", F.lit(0)).alias("rank"), "parent", F.coalesce("depth", F.lit(0)).alias("depth")), "claims")
        left, n = told.count(), -1
        while left != n:
            known = told.select("face", F.col("rid").alias("parent"))
            told = materialize(told.filter("parent IS NULL").unionByName(told.join(known, ["face", "parent"], "left_semi")), "claims")
            n, left = left, told.count()
    return told.groupBy("face").agg(F.min(F.struct("rank", (-F.col("depth")).alias("up"), "size", "rid")).alias("m")).select("face", "m.rid")


def _deep(witnesses: DataFrame) -> DataFrame:
    """Witnesses with the number of parents above them; those whose chain never ends have none."""
    done = materialize(witnesses.filter("parent IS NULL").withColumn("depth", F.lit(0)), "deep")
    front, depth = done, 0
    while not front.isEmpty():
        depth += 1
        front = materialize(witnesses.join(front.select(F.col("rid").alias("parent")), "parent").select("rid", "rank", "parent", F.lit(depth).alias("depth")), "deep")
        done = done.unionByName(front)
    return done


def seeded(owner: DataFrame, seeds: DataFrame, traced: DataFrame) -> DataFrame:
    """Owners after each seed (rid, y, x) claimed the face that holds it; of several seeds in a face the greatest rid has it."""
    at = innermost(seeds.select(F.col("rid").alias("k"), "y", "x"), traced).groupBy("face").agg(F.max("k").alias("seed"))
    return owner.join(at, "face", "full").select("face", F.coalesce("seed", "rid").alias("rid"))


def _edge_sides(sides: DataFrame, owner: DataFrame) -> DataFrame:
    """(uy, ux, vy, vx, lf, lo, rf, ro): each edge with the faces and owners on its left and right."""
    side = sides.join(owner.withColumnRenamed("face", "cycle"), "cycle", "left")
    left = side.select(F.col("h.oy").alias("uy"), F.col("h.ox").alias("ux"), F.col("h.dy").alias("vy"), F.col("h.dx").alias("vx"), F.col("cycle").alias("lf"), F.col("rid").alias("lo"))
    right = side.select(F.col("h.dy").alias("uy"), F.col("h.dx").alias("ux"), F.col("h.oy").alias("vy"), F.col("h.ox").alias("vx"), F.col("cycle").alias("rf"), F.col("rid").alias("ro"))
    return left.join(right, KEY)


KEY = ["uy", "ux", "vy", "vx"]


def healed(edges: DataFrame, rings: DataFrame, least_area: float = 0.0, witnesses: DataFrame | None = None):
    """(edges, sides, faces, owner) without edges that have one face, or no claimed face, on both sides; until none is left.

    Edges inside one face fall first; then small faces and enclosed pockets go to neighbours, and edges that bound nothing claimed fall.
    """
    none = None
    told = rings if witnesses is not None else materialize(first_of_equal(rings), "told")
    while True:
        traced = materialize(cycles(half_edges(edges)), "traced")
        if none is None:
            none = traced.select(F.col("cycle").alias("face"), F.lit(0).cast("long").alias("rid")).limit(0)
        # edges within one face are bridges: the same cycle runs along both of their sides
        inner = materialize(edges.select(*KEY).join(_edge_sides(traced, none).filter("lf = rf"), KEY, "left_semi"), "inner")
        if not inner.isEmpty():
            edges = materialize(edges.join(inner, KEY, "left_anti"), "edges")
            continue
        sides = materialize(located(traced), "sides")
        faces = materialize(bounded_faces(sides, traced), "faces")
        owner = materialize(absorbed(owned(claims(faces, told), ring_sizes(told), witnesses), faces, sides, least_area), "owner")
        loose = materialize(edges.select(*KEY).join(_edge_sides(sides, owner).filter("lo IS NULL AND ro IS NULL"), KEY, "left_semi"), "loose")
        if loose.isEmpty():
            return edges, sides, faces, owner
        edges = materialize(edges.join(loose, KEY, "left_anti"), "edges")


def settled(owner: DataFrame, picks: DataFrame) -> DataFrame:
    """Owners (face, rid) after each face of ``picks`` (face, other), in order of their names, took the owner that ``other`` had by then.

    A face that picks an earlier one of the picks gets what that one got, so faces point to earlier faces and chains of them are
    followed by doubling, in as many rounds as the logarithm of the longest; a pick that comes later still has its owner of before.
    """
    told = picks.join(picks.select(F.col("face").alias("other"), F.lit(True).alias("goes")), "other", "left").select(
        "face", "other", F.when(F.col("goes") & (F.col("other") < F.col("face")), F.col("other")).otherwise(F.col("face")).alias("root"))
    told = materialize(told, "picks")
    state = told.select("face", "root")
    while True:
        up = state.select(F.col("face").alias("root"), F.col("root").alias("next"))
        new = materialize(state.join(up, "root").select("face", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "picks")
        state = new.select("face", "root")
        if new.filter("moved").isEmpty():
            break
    end = state.join(told.select(F.col("face").alias("root"), "other"), "root").select("face", "other")
    to = end.join(owner.select(F.col("face").alias("other"), F.col("rid").alias("to")), "other", "left").select("face", "to", F.lit(True).alias("goes"))
    return owner.join(to, "face", "full").select("face", F.when(F.col("goes"), F.col("to")).otherwise(F.col("rid")).alias("rid")).filter("rid IS NOT NULL")


def absorbed(owner: DataFrame, faces: DataFrame, sides: DataFrame, least_area: float) -> DataFrame:
    """Owners after each bounded face below ``least_area``, and each unclaimed one of any size, in order of their names, took the owner
    that the neighbour with which it shares the longest boundary had by then; where that is nobody's, so is the face."""
    h = lambda c: F.col(f"h.{c}").cast("double")
    small = faces.filter("area > 0").join(owner, "face", "left").filter((F.col("area") < least_area) | F.col("rid").isNull()).select("face")
    here = sides.select("h", F.col("cycle").alias("face"), F.hypot(h("dy") - h("oy"), h("dx") - h("ox")).alias("len")).join(small, "face")
    twin = sides.select(F.struct(F.col("h.dy").alias("oy"), F.col("h.dx").alias("ox"), F.col("h.oy").alias("dy"), F.col("h.ox").alias("dx")).alias("h"), F.col("cycle").alias("other"))
    shared = here.join(twin, "h").filter(~F.col("face").eqNullSafe(F.col("other"))).groupBy("face", "other").agg(F.sum("len").alias("len"))
    picks = shared.groupBy("face").agg(F.min(F.struct((-F.col("len")).alias("len"), "other"))["other"].alias("other"))
    return settled(owner, picks)


def dissolved(owner: DataFrame, traced: DataFrame) -> DataFrame:
    """(rid, h): half edges on the outline of each owner's faces, those whose twin belongs to another owner or to none."""
    side = traced.join(owner.withColumnRenamed("face", "cycle"), "cycle", "left").select("h", "rid")
    twin = side.select(F.struct(F.col("h.dy").alias("oy"), F.col("h.dx").alias("ox"), F.col("h.oy").alias("dy"), F.col("h.ox").alias("dx")).alias("h"), F.col("rid").alias("other"))
    return side.join(twin, "h", "left").filter(F.col("rid").isNotNull() & ~F.col("rid").eqNullSafe(F.col("other"))).select("rid", "h")
