"""Overlay of rings on the sphere: node, cluster, split, trace faces, join holes, claim, absorb, heal, dissolve.

A vertex is its unit vector (a struct of doubles), an arc the shorter great circle between two. Rings come as arcs (rid, a, b). Places
where witnesses come within ``tau_vertex`` of each other become one vertex, the mean of its cluster, and arcs are cut at every vertex
within ``tau_edge`` of them; as both move arcs a little, this is done again until nothing moves. Nothing is projected: turning orders
are bearings in the vertex's own tangent plane, areas are sums of spherical triangles, and the outside is a face like the others, so
areas of faces sum to the whole sphere. Boundaries of one face that don't touch meet by rays: each part of the net sends one from its
northernmost point to the pole; the first arc that it meets bounds the same face.

Joins go by cells of the cube around the sphere (arcs) or by strips of longitude (rays), loops by rounds of tables.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions import geo as g
from tempora.operators import spatial as sp
from tempora.operators.graph import connected_components
from tempora.operators.overlay import cycles, owned, settled
from tempora.plans.scratch import materialize

C = F.col
WHOLE = 4 * math.pi
ASIDE = 1e-9  # how far a face's sample point lies from its longest edge, and rays from the vertex that they start at
ROUNDS = 50  # of noding, which takes two or three; more is an error


def _axis(x: float, y: float, z: float) -> Column:
    return F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z"))


def _pole() -> Column:
    return _axis(0.0, 0.0, 1.0)


def _held(rows: DataFrame, **columns) -> DataFrame:
    """Rows with further columns that later expressions refer to but never repeat: a generator stops the optimizer from putting
    one vector's expression into the next one's, which grows them tenfold each time."""
    for name, column in columns.items():
        rows = rows.withColumn(name, F.explode(F.array(column)))
    return rows


def ring_arcs(rings: DataFrame) -> DataFrame:
    """rid, a, b of rings (rid, seq, lat, lon in degrees): each vertex with the next, the last with the first."""
    w = Window.partitionBy("rid").orderBy("seq")
    v = rings.select("rid", "seq", g.vec("lat", "lon").alias("a"))
    nxt = F.coalesce(F.lead("a").over(w), F.first("a").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return v.select("rid", "a", nxt.alias("b")).filter("a <> b")


def _packed(x: Column, y: Column, z: Column) -> Column:
    """One number of a cell's three; each has 21 bits."""
    return ((x + (1 << 20)) * (1 << 42) + (y + (1 << 20)) * (1 << 21) + z + (1 << 20)).cast("long")


def _cell(v: Column, size: float) -> Column:
    return _packed(*[sp.cell(v[c], size) for c in "xyz"])


def _along(arcs: DataFrame, size: float, tau: float) -> DataFrame:
    """Arcs with each cell that they pass or pass by within ``tau``: those around points a quarter of a cell apart on them."""
    reach = size / 8 + tau + 1e-12
    steps = F.greatest(F.lit(1), F.ceil(g.angle(C("a"), C("b")) / (size / 4)).cast("int"))
    points = F.transform(F.sequence(F.lit(0), C("_steps")), lambda i: g.slerp(C("a"), C("b"), i / C("_steps")))
    every = lambda v, c: sp.cells_of(v[c] - reach, v[c] + reach, size)
    cells = lambda v: F.flatten(F.transform(every(v, "x"), lambda x: F.flatten(F.transform(every(v, "y"), lambda y: F.transform(every(v, "z"), lambda z: _packed(x, y, z))))))
    arcs = _held(_held(arcs, _steps=steps), _points=points)
    return arcs.withColumn("cell", F.explode(F.array_distinct(F.flatten(F.transform("_points", cells))))).drop("_steps", "_points")


def _meetings(pairs: DataFrame, tau: float) -> DataFrame:
    """v: where arcs (a, b) and (c, d) with normals n and m cross, farther than ``tau`` from their ends (ends cut other arcs as vertices beside
    them); arcs of one great circle don't."""
    pairs = _held(_held(pairs, line=g.cross(C("n"), C("m"))).filter(g.norm(C("line")) > 1e-9), p=g.unit(C("line")))
    pairs = _held(pairs, v=F.when(g.dot(C("p"), g.plus(C("a"), C("b"))) >= 0, C("p")).otherwise(g.scale(C("p"), -1.0)))
    between = lambda u, w, n: (g.dot(g.cross(C(n), C(u)), C("v")) > 0) & (g.dot(g.cross(C(w), C(n)), C("v")) > 0)
    pairs = pairs.filter(between("a", "b", "n") & between("c", "d", "m"))
    return pairs.filter(F.least(*[g.angle(C(e), C("v")) for e in "abcd"]) > tau).select("v")


def arcs_beside(points: DataFrame, arcs: DataFrame, radius: float) -> DataFrame:
    """(k, arc): points (k, v) and arcs (arc, a, b) at most ``radius`` apart. Arcs enter the cells that they pass by, points their own."""
    arcs = arcs.withColumn("w", g.angle(C("a"), C("b")))
    size = max(arcs.agg(F.avg("w")).first()[0] or 0.0, 8 * radius, 2e-6)
    met = _along(arcs, size, radius).join(points.select("k", "v", _cell(C("v"), size).alias("cell")), "cell")
    met = _held(_held(met, n=g.cross(C("a"), C("b"))), n=g.unit(C("n")))
    over = (g.dot(g.cross(C("n"), C("a")), C("v")) >= 0) & (g.dot(g.cross(C("b"), C("n")), C("v")) >= 0)
    ends = F.least(g.angle(C("v"), C("a")), g.angle(C("v"), C("b")))
    return met.filter(F.when(over, F.abs(F.asin(g.clamp(g.dot(C("v"), C("n")))))).otherwise(ends) <= radius).select("k", "arc")


def noded(arcs: DataFrame, tau_vertex: float, tau_edge: float) -> DataFrame:
    """(u, v, rid, n): edges of the arrangement with their witnesses; n is 1 where the ring bounds something there, 0 where it runs to and fro."""
    arcs = materialize(arcs.select("rid", "a", "b", F.lit(1).alias("n")), "arcs")
    for _ in range(ROUNDS):
        edges = materialize(_noded_once(arcs, tau_vertex, tau_edge).select("rid", C("u").alias("a"), C("v").alias("b"), "n"), "arcs")
        if edges.count() == arcs.count() and edges.join(arcs, ["rid", "a", "b"], "left_anti").isEmpty():
            return edges.select(C("a").alias("u"), C("b").alias("v"), "rid", "n")
        arcs = edges
    raise ArithmeticError("clusters of vertices do not settle")


def _noded_once(arcs: DataFrame, tau_vertex: float, tau_edge: float) -> DataFrame:
    lines = materialize(arcs.groupBy("a", "b").agg(F.first(g.angle(C("a"), C("b"))).alias("w")).withColumn("n", g.unit(g.cross(C("a"), C("b")))), "lines")
    tau = max(tau_vertex, tau_edge)
    size = max(lines.agg(F.avg("w")).first()[0] or 0.0, 8 * tau, 2e-6)
    own = _along(lines, size, tau)
    other = own.select("cell", C("a").alias("c"), C("b").alias("d"), C("n").alias("m"))
    pairs = own.select("cell", "a", "b", "n").join(other, "cell").filter(F.struct("a", "b") < F.struct("c", "d"))
    meets = _meetings(pairs, tau_vertex)
    places = materialize(lines.select(C("a").alias("v")).union(lines.select("b")).union(meets).distinct(), "places")
    close = sp.within(places.select(C("v").alias("k"), "v"), tau_vertex)
    parts = connected_components(close.select("a", "b")).withColumnRenamed("id", "v")
    members = places.join(parts, "v", "left").withColumn("part", F.coalesce("component", "v"))
    zero = g.scale(_pole(), 0.0)
    mean = members.groupBy("part").agg(F.array_sort(F.collect_list("v")).alias("vs")).select("vs", g.unit(F.aggregate("vs", zero, g.plus)).alias("mean"))  # clusters are as small as the tolerance
    mean = mean.select("vs", F.when(F.size("vs") == 1, F.get("vs", F.lit(0))).otherwise(C("mean")).alias("rep"))
    place = materialize(mean.select(F.explode("vs").alias("v"), "rep"), "places")
    ends = lines.join(place.select(C("v").alias("a"), C("rep").alias("ra")), "a").join(place.select(C("v").alias("b"), C("rep").alias("rb")), "b").filter("ra <> rb")
    reps = place.select("rep").distinct().withColumn("cell", _cell(C("rep"), size))
    foot = g.unit(g.plus(C("rep"), g.scale(C("n"), -g.dot(C("rep"), C("n")))))
    beside = _along(ends, size, tau).join(reps, "cell").filter("rep <> ra AND rep <> rb")
    beside = _held(beside.filter(F.abs(F.asin(g.clamp(g.dot(C("rep"), C("n"))))) <= tau_edge), f=foot)
    sa, sb = g.angle(C("a"), C("f")), g.angle(C("f"), C("b"))
    beside = beside.filter((F.abs(sa + sb - C("w")) <= tau_edge) & (sa > tau_vertex / 2) & (sb > tau_vertex / 2)).select("a", "b", "rep", sa.alias("at")).distinct()
    cuts = beside.union(ends.select("a", "b", "ra", F.lit(-1.0))).union(ends.select("a", "b", "rb", C("w") + 1))
    w = Window.partitionBy("a", "b").orderBy("at", "rep")
    steps = cuts.withColumn("to", F.lead("rep").over(w)).filter("to IS NOT NULL AND to <> rep").select("a", "b", F.least("rep", "to").alias("u"), F.greatest("rep", "to").alias("v"))
    return arcs.join(steps, ["a", "b"]).groupBy("u", "v", "rid").agg((F.sum("n") % 2).cast("int").alias("n"))


def half_edges(edges: DataFrame) -> DataFrame:
    """(h, nxt): both directions (o, d) of every edge (u, v), each with the next one around the face on its left."""
    both = edges.select(C("u").alias("o"), C("v").alias("d")).union(edges.select("v", "u"))
    h = F.struct("o", "d")
    w = Window.partitionBy("o").orderBy("turn", "d")
    # directions are counter-clockwise from outside, near the poles from another axis
    both = _held(both, axis=F.when(F.abs(C("o.z")) > 0.9, _axis(1.0, 0.0, 0.0)).otherwise(_pole()))
    both = _held(_held(both, east=g.cross(C("axis"), C("o"))), north=g.cross(C("o"), C("east")))
    around = both.withColumn("turn", F.atan2(g.dot(C("north"), C("d")), g.dot(C("east"), C("d")))).withColumn("before", F.coalesce(F.lag(h).over(w), F.last(h).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    return around.select(F.struct(C("d").alias("o"), C("o").alias("d")).alias("h"), C("before").alias("nxt"))


def _flat(traced: DataFrame) -> DataFrame:
    return traced.select("h.o", "h.d", "cycle")


def cycle_areas(traced: DataFrame) -> DataFrame:
    """cycle, area (steradians on its left)."""
    apex = traced.groupBy("cycle").agg(F.min("h.o").alias("p"))
    sums = _flat(traced).join(apex, "cycle").groupBy("cycle").agg(F.sum(g.triangle_area(C("p"), C("o"), C("d"))).alias("area"))
    return sums.select("cycle", F.pmod("area", F.lit(WHOLE)).alias("area"))


def _lon(v: Column) -> Column:
    return F.pmod(F.atan2(v["y"], v["x"]), F.lit(2 * math.pi))


def _strip(lon: Column, strips: int) -> Column:
    return F.floor(F.pmod(lon, F.lit(2 * math.pi)) / (2 * math.pi) * strips).cast("long") % strips


def _strips_for(arcs: DataFrame) -> int:
    """As many strips as make an arc cross about one."""
    east = F.abs(F.pmod(_lon(C("d")) - _lon(C("o")) + math.pi, F.lit(2 * math.pi)) - math.pi)
    mean = arcs.agg(F.avg(east)).first()[0] or 0.1
    return int(min(1 << 22, max(64, 2 * math.pi / max(mean, 1e-9))))


def _westward(arcs: DataFrame, strips: int) -> DataFrame:
    """Arcs (o, d) that head west, in every strip that they cross."""
    west = arcs.filter(g.cross(C("o"), C("d"))["z"] < 0)
    first = F.floor(_lon(C("d")) / (2 * math.pi) * strips).cast("long")
    last = F.floor(_lon(C("o")) / (2 * math.pi) * strips).cast("long")
    return west.withColumn("strip", F.explode(F.sequence(first, F.when(_lon(C("o")) < _lon(C("d")), last + strips).otherwise(last)))).withColumn("strip", C("strip") % strips)


def _met(rows: DataFrame) -> DataFrame:
    """Rows whose arc (o, d), heading west, crosses the meridian ``lon``, with the place q."""
    m = F.struct((-F.sin("lon")).alias("x"), F.cos("lon").alias("y"), F.lit(0.0).alias("z"))
    rows = rows.withColumn("one", g.dot(C("o"), m)).withColumn("two", g.dot(C("d"), m)).filter("one > 0 AND two <= 0")
    rows = _held(_held(rows, q=g.plus(g.scale(C("o"), -C("two")), g.scale(C("d"), C("one")))), q=g.unit(C("q")))
    return rows.filter(C("q.x") * F.cos("lon") + C("q.y") * F.sin("lon") > 0).drop("one", "two")


def _tops(arcs: DataFrame) -> DataFrame:
    """Arcs (o, d) with n (normal), top (northernmost point of the great circle) and bulges (whether that lies within the arc)."""
    arcs = _held(_held(arcs, n=g.cross(C("o"), C("d"))), n=g.unit(C("n"))).filter("n IS NOT NULL")
    arcs = _held(_held(arcs, top=g.plus(_pole(), g.scale(C("n"), -C("n.z")))), top=g.unit(C("top")))
    return arcs.withColumn("bulges", F.coalesce((g.dot(g.cross(C("n"), C("o")), C("top")) > 0) & (g.dot(g.cross(C("d"), C("n")), C("top")) > 0), F.lit(False)))


def located(traced: DataFrame) -> DataFrame:
    """(h, cycle, face): the face of each half edge; a face is named by the least of its cycles."""
    ends = _flat(traced)
    part = connected_components(ends.select(C("o").alias("a"), C("d").alias("b"))).select(C("id").alias("o"), C("component").alias("part"))
    half = materialize(ends.join(part, "o"), "half")
    seen = _held(half, north=g.plus(_pole(), g.scale(C("o"), -C("o.z"))), ahead=g.plus(C("d"), g.scale(C("o"), -g.dot(C("o"), C("d")))))
    left = F.pmod(F.atan2(g.dot(C("o"), g.cross(C("ahead"), C("north"))), g.dot(C("ahead"), C("north"))), F.lit(2 * math.pi))  # from the edge round to the north
    told = seen.select("part", F.struct(C("o.z").alias("z"), (-left).alias("s"), C("o").alias("p"), "cycle").alias("t")).union(
        _tops(half).filter("bulges AND n.z > 0").select("part", F.struct(C("top.z").alias("z"), F.lit(1.0).alias("s"), C("top").alias("p"), "cycle")))
    tops = told.groupBy("part").agg(F.max("t").alias("t")).select("part", "t.cycle", "t.p", (_lon(C("t.p")) + ASIDE).alias("lon"))
    strips = _strips_for(ends)
    rays = materialize(tops.withColumn("strip", _strip(C("lon"), strips)), "rays")
    met = _met(rays.join(_westward(half.select("o", "d", C("cycle").alias("other"), C("part").alias("its")), strips), "strip").filter("its <> part")).filter("q.z > p.z")
    first = met.groupBy("part").agg(F.min(F.struct("q.z", "other")).alias("m")).select("part", "m.other")
    links = materialize(rays.join(first, "part", "left").select("cycle", "other"), "links")
    outer = links.filter("other IS NULL").agg(F.min("cycle").alias("least"))
    links = links.join(F.broadcast(outer)).select(C("cycle").alias("a"), F.coalesce("other", "least").alias("b")).filter("a <> b")
    face = connected_components(links).select(C("id").alias("cycle"), C("component").alias("face"))
    return traced.join(face, "cycle", "left").select("h", "cycle", F.coalesce("face", "cycle").alias("face"))


def face_table(sides: DataFrame) -> DataFrame:
    """face, area (steradians), n (edges on its boundaries), cycles (its boundaries), p (a point inside, beside its longest edge)."""
    areas = cycle_areas(sides.select("h", "cycle"))
    boundaries = sides.select("face", "cycle").distinct().join(areas, "cycle").groupBy("face").agg((F.sum("area") - WHOLE * (F.count("*") - 1)).alias("area"), F.count("*").alias("cycles"))
    o, d = C("h.o"), C("h.d")
    longest = sides.groupBy("face").agg(F.count("*").alias("n"), F.max(F.struct(g.angle(o, d).alias("w"), "h"))["h"].alias("h"))
    inner = _held(_held(longest, mid=g.unit(g.plus(o, d)), aside=g.unit(g.cross(o, d))), p=g.plus(C("mid"), g.scale(C("aside"), ASIDE)))
    inner = _held(inner, p=g.unit(C("p")))
    return boundaries.join(inner, "face").select("face", "area", "n", "cycles", "p")


def ring_sizes(arcs: DataFrame) -> DataFrame:
    """rid, size (of the smaller side, which is the inside), turns (times round the pole, eastward), left (whether the inside is on its left)."""
    apex = arcs.groupBy("rid").agg(F.min("a").alias("p"))
    east = F.pmod(_lon(C("b")) - _lon(C("a")) + math.pi, F.lit(2 * math.pi)) - math.pi
    sums = arcs.join(apex, "rid").groupBy("rid").agg(F.pmod(F.sum(g.triangle_area(C("p"), C("a"), C("b"))), F.lit(WHOLE)).alias("area"), F.round(F.sum(east) / (2 * math.pi)).cast("int").alias("turns"))
    return sums.select("rid", F.least("area", WHOLE - C("area")).alias("size"), "turns", (C("area") <= WHOLE / 2).alias("left"))


def _lat(v: Column) -> Column:
    return F.round(F.degrees(F.asin(g.clamp(v["z"]))) * 1e7).cast("long")


def claims(faces: DataFrame, edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """(face, rid): the rings that hold each face. ``edges`` as :func:`noded` gives them, so that clusters don't move a ring over a face's point.

    A face is inside where the way from its point north to the pole crosses the ring an odd number of times, or an even number for a
    ring that has the pole inside. Faces meet rings whose latitudes and strips of longitude they share.
    """
    ends = edges.filter("n = 1").select("rid", C("u").alias("o"), C("v").alias("d"))
    both = ends.union(ends.select("rid", "d", "o"))
    reach = _held(_tops(both), other=g.scale(C("top"), -1.0))  # each edge stands both ways round; the southernmost point is opposite the northernmost
    south = (g.dot(g.cross(C("n"), C("o")), C("other")) > 0) & (g.dot(g.cross(C("d"), C("n")), C("other")) > 0)
    reach = reach.withColumn("low", F.when(south, _lat(C("other"))).otherwise(F.least(_lat(C("o")), _lat(C("d"))))).withColumn("high", F.when(C("bulges"), _lat(C("top"))).otherwise(F.greatest(_lat(C("o")), _lat(C("d")))))
    strips = _strips_for(ends)
    above = materialize(_westward(both, strips), "above")  # each edge once: one of its directions heads west
    north = (C("turns") > 0) == C("left")
    box = reach.groupBy("rid").agg((F.min("low") - 10).alias("y0"), (F.max("high") + 10).alias("y1")).join(sizes, "rid").withColumn("around", C("turns") != 0).withColumn("north", C("around") & north)
    whole = 900_000_010
    box = box.withColumn("y1", F.when(C("north"), F.lit(whole)).otherwise(C("y1"))).withColumn("y0", F.when(C("around") & ~C("north"), F.lit(-whole)).otherwise(C("y0")))
    level = F.ceil(F.log2((C("y1") - C("y0")).cast("double") + 2)).cast("int")
    cut = lambda c: F.call_function("shiftright", C(c), C("level"))
    box = box.withColumn("level", level).withColumn("cy", F.explode(F.sequence(cut("y0"), cut("y1"))))
    strip = above.select("rid", "strip").distinct()
    box = materialize(box.join(strip, "rid", "left").withColumn("at", F.when(~C("around"), C("strip"))).select("rid", "level", "cy", "y0", "y1", "north", "at").distinct(), "boxes")
    levels = [r.level for r in box.select("level").distinct().collect()]  # 32 at most
    pts = faces.select("face", C("p.z").alias("z"), _lat(C("p")).alias("y"), _lon(C("p")).alias("lon")).withColumn("strip", _strip(C("lon"), strips))
    pts = pts.withColumn("level", F.explode(F.array(*[F.lit(k) for k in levels]) if levels else F.array().cast("array<int>"))).withColumn("cy", cut("y"))
    cand = pts.join(box.filter("at IS NOT NULL").withColumnRenamed("at", "strip"), ["level", "cy", "strip"]).filter("y BETWEEN y0 AND y1").select("face", "rid", "z", "lon", "strip", "north")
    polar = pts.join(box.filter("at IS NULL").drop("at"), ["level", "cy"]).filter("y BETWEEN y0 AND y1").select("face", "rid", "z", "lon", "strip", "north")
    cand = materialize(cand.union(polar).distinct(), "candidates")
    hit = _met(cand.join(above, ["rid", "strip"])).filter("q.z > z")
    odd = hit.groupBy("face", "rid").agg((F.count("*") % 2 == 1).alias("odd"))
    return cand.select("face", "rid", "north").join(odd, ["face", "rid"], "left").filter(F.coalesce("odd", F.lit(False)) != C("north")).select("face", "rid")


def _two_sides(sides: DataFrame) -> DataFrame:
    """(h, face, other, w): each half edge with the faces on its left and right and its length."""
    twin = sides.select(F.struct(C("h.d").alias("o"), C("h.o").alias("d")).alias("h"), C("face").alias("other"))
    return sides.select("h", "face").join(twin, "h").withColumn("w", g.angle(C("h.o"), C("h.d")))


def absorbed(owner: DataFrame, faces: DataFrame, sides: DataFrame, least_area: float) -> DataFrame:
    """Owners (face, rid) after each claimed face below ``least_area``, and each unclaimed one but the largest (the outside), in order of
    their names, took the owner that its neighbour of longest shared boundary had by then."""
    told = faces.join(owner, "face", "left")
    outside = told.filter("rid IS NULL").agg(F.max(F.struct("area", "face"))["face"].alias("outside"))
    small = told.join(F.broadcast(outside)).filter((C("rid").isNull() | (C("area") < least_area)) & ~C("face").eqNullSafe(C("outside"))).select("face")
    shared = _two_sides(sides).filter("face <> other").join(small, "face").groupBy("face", "other").agg(F.sum("w").alias("w"))
    picks = shared.groupBy("face").agg(F.min(F.struct((-F.round("w", 12)).alias("w"), "other"))["other"].alias("other"))
    return settled(owner, picks)


def dissolved(owner: DataFrame, sides: DataFrame) -> DataFrame:
    """(rid, h): half edges on the outline of each owner's faces."""
    both = _two_sides(sides).join(owner, "face").join(owner.select(C("face").alias("other"), C("rid").alias("its")), "other", "left")
    return both.filter(~C("rid").eqNullSafe(C("its"))).select("rid", "h")


def overlaid(arcs: DataFrame, tau_vertex: float, tau_edge: float, least_area: float = 0.0, witnesses: DataFrame | None = None):
    """(edges, sides, faces, owner) of rings given as arcs, healed: no edge has one face, or no claimed face, on both sides."""
    sizes = materialize(ring_sizes(arcs), "sizes")
    edges = noded(arcs, tau_vertex, tau_edge)
    while True:
        net = edges.select("u", "v").distinct()
        traced = materialize(cycles(half_edges(net)), "traced")
        flat = _flat(traced)
        inner = flat.join(flat.select(C("d").alias("o"), C("o").alias("d"), "cycle"), ["o", "d", "cycle"]).select(F.least("o", "d").alias("u"), F.greatest("o", "d").alias("v")).distinct()
        inner = materialize(inner, "inner")
        if not inner.isEmpty():  # one cycle runs along both of their sides
            edges = materialize(edges.join(inner, ["u", "v"], "left_anti"), "edges")
            continue
        sides = materialize(located(traced), "sides")
        faces = materialize(face_table(sides), "faces")
        claimed = claims(faces, edges, sizes)
        owner = materialize(absorbed(owned(claimed, sizes, witnesses), faces, sides, least_area), "owner")
        both = _two_sides(sides)
        ours = owner.filter("rid IS NOT NULL").select("face")
        loose = both.join(ours, "face", "left_anti").join(ours.select(C("face").alias("other")), "other", "left_anti")
        loose = materialize(loose.select(F.least("h.o", "h.d").alias("u"), F.greatest("h.o", "h.d").alias("v")).distinct(), "loose")
        if loose.isEmpty():
            return edges, sides, faces, owner
        edges = materialize(edges.join(loose, ["u", "v"], "left_anti"), "edges")
