"""Queries on points, rings and paths."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tempora.functions import geo as g
from tempora.operators import edgecells as ec
from tempora.operators import spatial as sp
from tempora.operators import rings as rg
from tempora.operators.rings import resampled
from tempora.plans import fixtures as fx
from tempora.plans.catalog import query
from tempora.plans.fixtures import with_
from tempora.plans.scratch import materialize

R300 = 300.0 / 6371.0
DOT = lambda a, b: f"({a}x*{b}x+{a}y*{b}y+{a}z*{b}z)"
ANG = lambda a, b: f"acos(greatest(-1.0, least(1.0, {DOT(a, b)})))"


def points(spark, sf):
    return fx.geo(spark, sf).withColumn("v", g.vec("lat", "lon"))


def ring_vectors(spark, sf):
    return fx.rings(spark, sf).withColumn("v", g.vec(F.col("qlat") / 1e7, F.col("qlon") / 1e7))


def path_points(spark, sf):
    return fx.paths(spark, sf).withColumn("v", g.vec("lat", "lon"))


def path_segments(spark, sf):
    """id, seq, v, n (next point), w (angle to it)."""
    w = Window.partitionBy("id").orderBy("seq")
    return path_points(spark, sf).withColumn("n", F.lead("v").over(w)).filter("n IS NOT NULL").withColumn("w", g.angle(F.col("v"), F.col("n")))


PSEG = """, pseg AS (SELECT id, seq, x, y, z, lead(x) OVER w nx, lead(y) OVER w ny, lead(z) OVER w nz FROM pvec WINDOW w AS (PARTITION BY id ORDER BY seq)),
  plen AS (SELECT *, acos(greatest(-1.0, least(1.0, x*nx+y*ny+z*nz))) w FROM pseg WHERE nx IS NOT NULL) """


@query("F1_unit_vectors", with_("geo") + "SELECT k, round(x,9) AS x, round(y,9) AS y, round(z,9) AS z, round(degrees(asin(z)),6) AS lat2, round(degrees(atan2(y,x)),6) AS lon2 FROM vec")
def f1(spark, sf):
    p = points(spark, sf)
    return p.select("k", *[F.round(f"v.{c}", 9).alias(c) for c in "xyz"], F.round(g.lat_of(F.col("v")), 6).alias("lat2"), F.round(g.lon_of(F.col("v")), 6).alias("lon2"))


@query("F2_vector_algebra", with_("geo") + """SELECT k, round(x*0.6+z*0.8,9) AS d, round(acos(greatest(-1.0,least(1.0,x*0.6+z*0.8)))*6371,3) AS km, round(y*0.8,9) AS cx, round(z*0.6-x*0.8,9) AS cy, round(-y*0.6,9) AS cz FROM vec""")
def f2(spark, sf):
    fixed = F.struct(F.lit(0.6).alias("x"), F.lit(0.0).alias("y"), F.lit(0.8).alias("z"))
    c = g.cross(F.col("v"), fixed)
    return points(spark, sf).select("k", F.round(g.dot(F.col("v"), fixed), 9).alias("d"), F.round(g.angle(F.col("v"), fixed) * g.EARTH_KM, 3).alias("km"),
                                    F.round(c["x"], 9).alias("cx"), F.round(c["y"], 9).alias("cy"), F.round(c["z"], 9).alias("cz"))


@query("F3_slerp", with_("geo") + """, s AS (SELECT k, x, y, z, acos(greatest(-1.0,least(1.0,z))) w FROM vec)
  SELECT k, round(x*sin(0.75*w)/sin(w),7) AS x, round(y*sin(0.75*w)/sin(w),7) AS y, round((z*sin(0.75*w)+sin(0.25*w))/sin(w),7) AS z FROM s""")
def f3(spark, sf):
    pole = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("z"))
    return points(spark, sf).select("k", g.slerp(F.col("v"), pole, F.lit(0.25)).alias("s")).select("k", *[F.round(f"s.{c}", 7).alias(c) for c in "xyz"])


@query("F3_ring_morph", with_("rvec") + """, m AS (SELECT a.rid, a.seq, a.x ax, a.y ay, a.z az, b.x bx, b.y by_, b.z bz, acos(greatest(-1.0,least(1.0,a.x*b.x+a.y*b.y+a.z*b.z))) w FROM rvec a JOIN rvec b ON b.rid = a.rid + 1 AND b.seq = a.seq)
  SELECT rid, seq, round((ax*sin(0.6*w)+bx*sin(0.4*w))/sin(w),7) AS x, round((ay*sin(0.6*w)+by_*sin(0.4*w))/sin(w),7) AS y, round((az*sin(0.6*w)+bz*sin(0.4*w))/sin(w),7) AS z FROM m""")
def f3_rings(spark, sf):
    """Every ring on its way to the next one: vertices of equal place interpolated pairwise."""
    r = ring_vectors(spark, sf)
    return morphed(r, r.withColumn("rid", F.col("rid") - 1), 0.4).select("rid", "seq", *[F.round(f"v.{c}", 7).alias(c) for c in "xyz"])


def morphed(before, after, t: float):
    """rid, seq, v: rings (rid, seq, v) of one id and number of vertices, ``t`` of the way from one to the other; null between antipodes."""
    return before.select("rid", "seq", F.col("v").alias("a")).join(after.select("rid", "seq", F.col("v").alias("b")), ["rid", "seq"]).select(
        "rid", "seq", g.slerp(F.col("a"), F.col("b"), F.lit(t)).alias("v"))


@query("T8_morph_points", with_("paths") + """, many AS (SELECT id, count(*) m FROM pvec GROUP BY 1 HAVING count(*) > 1),
  pairs AS (SELECT a.id, greatest(a.m, b.m) n FROM many a JOIN many b ON b.id = a.id + 1),
  need AS (SELECT id line, id pair, 0 side, n FROM pairs UNION ALL SELECT id + 1, id, 1, n FROM pairs),
  leg AS (SELECT id, seq, x, y, z, lead(x) OVER w nx, lead(y) OVER w ny, lead(z) OVER w nz, row_number() OVER w rn FROM pvec WINDOW w AS (PARTITION BY id ORDER BY seq)),
  cum AS (SELECT *, acos(greatest(-1.0, least(1.0, x*nx+y*ny+z*nz))) len, sum(acos(greatest(-1.0, least(1.0, x*nx+y*ny+z*nz)))) OVER (PARTITION BY id ORDER BY seq) c1 FROM leg WHERE nx IS NOT NULL),
  legs AS (SELECT *, coalesce(lag(c1) OVER (PARTITION BY id ORDER BY seq), 0.0) c0, max(c1) OVER (PARTITION BY id) total FROM cum),
  at_ AS (SELECT * FROM (SELECT l.*, p.pair, p.side, p.n, unnest(range(CASE WHEN rn = 1 THEN 0 ELSE CAST(floor(c0/total*(n-1)) AS BIGINT) + 1 END, CAST(floor(c1/total*(n-1)) AS BIGINT) + 1)) i FROM legs l JOIN need p ON p.line = l.id)),
  s AS (SELECT pair, side, i, len, greatest(0.0, least(1.0, (total*i/(n-1) - c0)/len)) t, x, y, z, nx, ny, nz FROM at_),
  q AS (SELECT pair, side, i, (x*sin((1-t)*len)+nx*sin(t*len))/sin(len) x, (y*sin((1-t)*len)+ny*sin(t*len))/sin(len) y, (z*sin((1-t)*len)+nz*sin(t*len))/sin(len) z FROM s)
  SELECT a.pair AS boundary, a.i, round(a.x, 5) AS from_x, round(a.y, 5) AS from_y, round(a.z, 5) AS from_z, round(b.x, 5) AS to_x, round(b.y, 5) AS to_y, round(b.z, 5) AS to_z
  FROM q a JOIN q b ON b.pair = a.pair AND b.i = a.i AND a.side = 0 AND b.side = 1""")
def t8_morphs(spark, sf):
    """Geometry of morphs: every path and the next one, resampled to as many points as the longer one has, point by point."""
    lines = path_points(spark, sf).select("id", "seq", "v")
    many = materialize(lines.groupBy("id").agg(F.count("*").alias("m")).filter("m > 1"), "many")
    pairs = many.join(many.select((F.col("id") - 1).alias("id"), F.col("m").alias("m2")), "id").select("id", F.greatest("m", "m2").alias("n"))
    before = resampled(lines, "id", pairs)
    after = resampled(lines.withColumn("id", F.col("id") - 1), "id", pairs)
    both = before.withColumnRenamed("v", "a").join(after.withColumnRenamed("v", "b"), ["id", "i"])
    return both.select(F.col("id").alias("boundary"), "i", *[F.round(f"a.{c}", 5).alias(f"from_{c}") for c in "xyz"], *[F.round(f"b.{c}", 5).alias(f"to_{c}") for c in "xyz"])


@query("F4_distance_to_arc", with_("geo") + """, q AS (SELECT k, abs(asin(greatest(-1.0,least(1.0,z)))) off, x >= 0 AND y >= 0 inside, acos(greatest(-1.0,least(1.0,x))) a, acos(greatest(-1.0,least(1.0,y))) b FROM vec)
  SELECT k, round(CASE WHEN inside THEN off ELSE least(a, b) END * 6371, 3) AS km FROM q""")
def f4(spark, sf):
    a, b = (F.struct(F.lit(p).alias("x"), F.lit(q).alias("y"), F.lit(0.0).alias("z")) for p, q in ((1.0, 0.0), (0.0, 1.0)))
    return points(spark, sf).select("k", F.round(g.to_arc(F.col("v"), a, b) * g.EARTH_KM, 3).alias("km"))


@query("F5_bearing_and_triangle", with_("geo") + """SELECT k, round(degrees(atan2(y, x)),6) AS bearing, round(2.0*atan2(z, 1.0 + x + y),9) AS area FROM vec""")
def f5(spark, sf):
    # the frame of the pole: its east is the y axis turned to x, and the triangle with the x and y axes has a closed form
    ex, ey = (F.struct(F.lit(p).alias("x"), F.lit(q).alias("y"), F.lit(0.0).alias("z")) for p, q in ((1.0, 0.0), (0.0, 1.0)))
    at = F.atan2(g.dot(F.col("v"), ey), g.dot(F.col("v"), ex))
    return points(spark, sf).select("k", F.round(F.degrees(at), 6).alias("bearing"), F.round(g.triangle_area(F.col("v"), ex, ey), 9).alias("area"))


@query("F6_quantise", with_("geo") + "SELECT k, CAST(round(lat*1e7) AS BIGINT) AS qlat, CAST(round(lon*1e7) AS BIGINT) AS qlon, CAST(floor(lat/0.25) AS BIGINT) AS gy, CAST(floor(lon/0.25) AS BIGINT) AS gx FROM geo")
def f6(spark, sf):
    return fx.geo(spark, sf).select("k", g.quantised(F.col("lat")).alias("qlat"), g.quantised(F.col("lon")).alias("qlon"),
                                    sp.cell(F.col("lat"), 0.25).alias("gy"), sp.cell(F.col("lon"), 0.25).alias("gx"))


CENTRE = (0.6, 0.0, 0.8)


def _centre():
    return F.struct(*[F.lit(c).alias(n) for c, n in zip(CENTRE, "xyz", strict=True)])


@query("P3_viewport_points", with_("geo") + "SELECT k FROM vec WHERE acos(greatest(-1.0,least(1.0,x*0.6+z*0.8))) <= 0.5")
def p3(spark, sf):
    return points(spark, sf).filter(g.angle(F.col("v"), _centre()) <= 0.5).select("k")


@query("P5_front_hemisphere", with_("geo") + "SELECT k FROM vec WHERE x*0.6+z*0.8 >= 0")
def p5(spark, sf):
    return points(spark, sf).filter(g.dot(F.col("v"), _centre()) >= 0).select("k")


CAPS = """, mean AS (SELECT rid, avg(x) x, avg(y) y, avg(z) z FROM rvec GROUP BY 1),
  caps AS (SELECT rid, x/sqrt(x*x+y*y+z*z) cx, y/sqrt(x*x+y*y+z*z) cy, z/sqrt(x*x+y*y+z*z) cz FROM mean),
  radii AS (SELECT r.rid, any_value(cx) cx, any_value(cy) cy, any_value(cz) cz, max(acos(greatest(-1.0,least(1.0,x*cx+y*cy+z*cz)))) rad FROM rvec r JOIN caps c ON c.rid = r.rid GROUP BY 1) """


def bounding_caps(vertices):
    """rid, c (mean direction), rad (largest angle from it)."""
    mean = vertices.groupBy("rid").agg(F.struct(*[F.avg(f"v.{c}").alias(c) for c in "xyz"]).alias("m"))
    caps = mean.select("rid", g.unit(F.col("m")).alias("c"))
    return vertices.join(caps, "rid").groupBy("rid").agg(F.first("c").alias("c"), F.max(g.angle(F.col("v"), F.col("c"))).alias("rad"))


@query("A6_bounding_cap", with_("rvec") + CAPS + "SELECT rid, round(cx,6) AS cx, round(cy,6) AS cy, round(cz,6) AS cz, round(rad*6371,2) AS km FROM radii")
def a6(spark, sf):
    return bounding_caps(ring_vectors(spark, sf)).select("rid", *[F.round(f"c.{c}", 6).alias(f"c{c}") for c in "xyz"], F.round(F.col("rad") * g.EARTH_KM, 2).alias("km"))


@query("P4_cap_relevance", with_("rvec") + CAPS + """SELECT rid, CASE WHEN acos(greatest(-1.0,least(1.0,cx*cos(radians(15))+cy*sin(radians(15)))) ) <= rad + 0.08 THEN 'near' ELSE 'far' END AS detail FROM radii""")
def p4(spark, sf):
    view = g.vec(F.lit(0.0), F.lit(15.0))
    return bounding_caps(ring_vectors(spark, sf)).select("rid", F.when(g.angle(F.col("c"), view) <= F.col("rad") + 0.08, "near").otherwise("far").alias("detail"))


@query("A7_bounding_box", with_("rings") + "SELECT rid, min(qlat) AS y0, max(qlat) AS y1, min(qlon) AS x0, max(qlon) AS x1 FROM rings GROUP BY 1")
def a7(spark, sf):
    return sp.ring_boxes(fx.rings(spark, sf))


@query("A2_network_length", with_("paths") + PSEG + "SELECT id, round(sum(w)*6371, 2) AS km FROM plen GROUP BY 1")
def a2(spark, sf):
    return path_segments(spark, sf).groupBy("id").agg(F.round(F.sum("w") * g.EARTH_KM, 2).alias("km"))


def ring_areas(vertices):
    """rid, area (signed, steradians): triangles of every edge with the ring's first vertex, in any order."""
    w = Window.partitionBy("rid").orderBy("seq")
    apex = F.first("v").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    e = vertices.withColumn("n", F.coalesce(F.lead("v").over(w), apex)).withColumn("apex", apex)
    return e.groupBy("rid").agg(F.sum(g.triangle_area(F.col("apex"), F.col("v"), F.col("n"))).alias("area"))


AREA = """, e AS (SELECT rid, x, y, z, coalesce(lead(x) OVER w, first_value(x) OVER w) nx, coalesce(lead(y) OVER w, first_value(y) OVER w) ny, coalesce(lead(z) OVER w, first_value(z) OVER w) nz,
  first_value(x) OVER w px, first_value(y) OVER w py, first_value(z) OVER w pz FROM rvec WINDOW w AS (PARTITION BY rid ORDER BY seq)),
  areas AS (SELECT rid, sum(2.0*atan2(px*(y*nz-z*ny)+py*(z*nx-x*nz)+pz*(x*ny-y*nx), 1.0+(x*nx+y*ny+z*nz)+(nx*px+ny*py+nz*pz)+(px*x+py*y+pz*z))) area FROM e GROUP BY 1) """


@query("A3_spherical_area", with_("rvec") + AREA + "SELECT rid, round(area*6371*6371, 2) AS km2, sign(area)::BIGINT AS turn FROM areas")
def a3(spark, sf):
    return ring_areas(ring_vectors(spark, sf)).select("rid", F.round(F.col("area") * 6371 * 6371, 2).alias("km2"), F.signum("area").cast("long").alias("turn"))


@query("A4_planar_area", with_("redges") + "SELECT rid, round(abs(sum(ax*CAST(by_ AS DOUBLE) - bx*CAST(ay AS DOUBLE)))/2/1e14*cos(radians(avg(ay)/1e7)), 8) AS deg2 FROM redges GROUP BY 1")
def a4(spark, sf):
    e = sp.ring_edges(fx.rings(spark, sf))
    twice = F.abs(F.sum(F.col("ax") * F.col("by_").cast("double") - F.col("bx") * F.col("ay").cast("double")))
    return e.groupBy("rid").agg(F.round(twice / 2 / 1e14 * F.cos(F.radians(F.avg("ay") / 1e7)), 8).alias("deg2"))


@query("A5_winding", with_("redges") + ", c AS (SELECT rid, avg(ay) cy, avg(ax) cx FROM redges GROUP BY 1) SELECT rid, sign(sum((ax-cx)*(by_-cy)-(bx-cx)*(ay-cy)))::BIGINT AS turn FROM redges JOIN c USING (rid) GROUP BY 1")
def a5(spark, sf):
    e = sp.ring_edges(fx.rings(spark, sf))
    c = e.groupBy("rid").agg(F.avg("ay").alias("cy"), F.avg("ax").alias("cx"))
    t = (F.col("ax") - F.col("cx")) * (F.col("by_") - F.col("cy")) - (F.col("bx") - F.col("cx")) * (F.col("ay") - F.col("cy"))
    return e.join(c, "rid").groupBy("rid").agg(F.signum(F.sum(t)).cast("long").alias("turn"))


@query("A8_scene_centroid", with_("geo") + """, m AS (SELECT avg(x) x, avg(y) y, avg(z) z FROM vec), c AS (SELECT x/sqrt(x*x+y*y+z*z) cx, y/sqrt(x*x+y*y+z*z) cy, z/sqrt(x*x+y*y+z*z) cz FROM m)
  SELECT round(degrees(asin(any_value(cz))),4) AS lat, round(degrees(atan2(any_value(cy),any_value(cx))),4) AS lon, round(least(max(acos(greatest(-1.0,least(1.0,x*cx+y*cy+z*cz)))), pi()/2),5) AS radius FROM vec, c""")
def a8(spark, sf):
    p = points(spark, sf)
    c = p.agg(F.struct(*[F.avg(f"v.{x}").alias(x) for x in "xyz"]).alias("m")).select(g.unit(F.col("m")).alias("c"))
    j = p.join(F.broadcast(c))  # one row
    return j.agg(F.first("c").alias("c"), F.max(g.angle(F.col("v"), F.col("c"))).alias("r")).select(
        F.round(g.lat_of(F.col("c")), 4).alias("lat"), F.round(g.lon_of(F.col("c")), 4).alias("lon"), F.round(F.least(F.col("r"), F.pi() / 2), 5).alias("radius"))


@query("J5_point_in_polygon", with_("pip", "redges") + """, c AS (SELECT p.k, e.rid, count(*) n FROM pip p JOIN redges e ON (e.ay > p.y) <> (e.by_ > p.y) AND p.x < (e.bx-e.ax)*(p.y-e.ay)/(e.by_-e.ay)+e.ax GROUP BY 1, 2)
  SELECT k, rid FROM c WHERE n % 2 = 1""")
def j5(spark, sf):
    shapes, members = rg.by_shape(fx.rings(spark, sf))
    return rg.told(sp.points_in_rings(fx.pip(spark, sf), shapes), members, "rid").select("k", "rid")


@query("L15_water_sites", with_("pip", "redges") + """, c AS (SELECT p.k, e.rid, count(*) n FROM pip p JOIN redges e ON (e.ay > p.y) <> (e.by_ > p.y) AND p.x < (e.bx-e.ax)*(p.y-e.ay)/(e.by_-e.ay)+e.ax GROUP BY 1, 2)
  SELECT k, min(rid) AS water FROM c WHERE n % 2 = 1 GROUP BY 1""")
def l15(spark, sf):
    return sp.points_in_rings(fx.pip(spark, sf), rg.by_shape(fx.rings(spark, sf))[0]).groupBy("k").agg(F.min("rid").alias("water"))


@query("J6_point_ring_distance", with_("pip", "redges") + """, b AS (SELECT rid, min(ay) y0, max(ay) y1, min(ax) x0, max(ax) x1 FROM redges GROUP BY 1),
  n AS (SELECT k, y, x, rid FROM pip JOIN b ON y BETWEEN y0-500000 AND y1+500000 AND x BETWEEN x0-500000 AND x1+500000),
  d AS (SELECT n.k, n.rid, (y-ay)*1.0 py, (x-ax)*1.0 px, (by_-ay)*1.0 ey, (bx-ax)*1.0 ex FROM n JOIN redges e ON e.rid = n.rid),
  t AS (SELECT *, greatest(0.0, least(1.0, (px*ex+py*ey)/(ex*ex+ey*ey))) u FROM d)
  SELECT k, rid, round(min(sqrt((px-u*ex)*(px-u*ex)+(py-u*ey)*(py-u*ey)))/1e7, 8) AS deg FROM t GROUP BY 1, 2""")
def j6(spark, sf):
    shapes, members = rg.by_shape(fx.rings(spark, sf))
    near = ec.distances_near(fx.pip(spark, sf), sp.ring_edges(shapes), 500000)
    # rounded for shapes, before their members multiply the rows, and without decimals of any length
    deg = F.floor(F.col("d") / 1e7 * 1e8 + 0.5) / 1e8
    return rg.told(near.select("k", "rid", deg.alias("deg")), members, "rid").select("k", "rid", "deg")


@query("J8_shared_border_adjacency", with_("rings") + "SELECT a.rid AS a, b.rid AS b, count(*) AS n FROM rings a JOIN rings b ON a.qlat = b.qlat AND a.qlon = b.qlon AND a.rid < b.rid GROUP BY 1, 2 HAVING count(*) >= 2")
def j8(spark, sf):
    shapes, members = rg.by_shape(fx.rings(spark, sf))
    return rg.told(neighbours(shapes), members, "a", "b").filter("a < b").select("a", "b", "n")


def neighbours(shapes):
    """a, b, n: rings that share n vertices, two at least, in both directions; each also beside itself, as its copies are."""
    b = shapes.select(F.col("rid").alias("b"), "qlat", "qlon")
    return shapes.select(F.col("rid").alias("a"), "qlat", "qlon").join(b, ["qlat", "qlon"]).groupBy("a", "b").agg(F.count("*").alias("n")).filter("n >= 2")


@query("J11_distance_within", with_("geo") + f"SELECT p.k AS a, q.k AS b, round(acos(greatest(-1.0,least(1.0,p.x*q.x+p.y*q.y+p.z*q.z)))*6371, 2) AS km FROM vec p JOIN vec q ON p.k < q.k AND acos(greatest(-1.0,least(1.0,p.x*q.x+p.y*q.y+p.z*q.z))) <= {R300}")
def j11(spark, sf):
    km = F.floor(F.col("w") * g.EARTH_KM * 100 + 0.5) / 100  # rounded without decimals of any length, which would take longer than the join
    return sp.pairs_within(points(spark, sf), R300).select("a", "b", km.alias("km"))


@query("J10_vertex_snap", with_("pip", "rings") + """, c AS (SELECT k, k // 100 path, rid, seq, (y-qlat)*(y-qlat)+(x-qlon)*(x-qlon) d FROM pip JOIN rings ON abs(y-qlat) <= 500000 AND abs(x-qlon) <= 500000),
  n AS (SELECT path, k, qlat, qlon FROM (SELECT path, k, r.qlat, r.qlon, row_number() OVER (PARTITION BY k ORDER BY d, r.qlat, r.qlon) rn FROM c JOIN rings r USING (rid, seq) WHERE d <= 250000000000) WHERE rn = 1)
  SELECT path, k, qlat, qlon FROM n WINDOW w AS (PARTITION BY path ORDER BY k) QUALIFY lag(qlat) OVER w IS DISTINCT FROM qlat OR lag(qlon) OVER w IS DISTINCT FROM qlon""")
def j10(spark, sf):
    size = 500000.0
    verts = fx.rings(spark, sf).select("qlat", "qlon").distinct()
    spread = verts.select("*", F.explode(sp.cells_around(F.col("qlat"), size)).alias("cy")).select("*", F.explode(sp.cells_around(F.col("qlon"), size)).alias("cx"))
    p = fx.pip(spark, sf).withColumn("cy", sp.cell(F.col("y"), size)).withColumn("cx", sp.cell(F.col("x"), size))
    d = (F.col("y") - F.col("qlat")) * (F.col("y") - F.col("qlat")) + (F.col("x") - F.col("qlon")) * (F.col("x") - F.col("qlon"))
    near = p.join(spread, ["cy", "cx"]).withColumn("d", d).filter(F.col("d") <= 250000000000)
    best = near.groupBy("k").agg(F.min(F.struct("d", "qlat", "qlon")).alias("b")).select(F.floor(F.col("k") / 100).alias("path"), "k", "b.qlat", "b.qlon")
    w = Window.partitionBy("path").orderBy("k")
    moved = ~(F.lag("qlat").over(w).eqNullSafe(F.col("qlat")) & F.lag("qlon").over(w).eqNullSafe(F.col("qlon")))
    return best.withColumn("moved", moved).filter("moved").drop("moved")


def _shifted(edges, dy=300000, dx=30000):
    return edges.select("rid", "seq", *[(F.col(c) + (dy if c in ("ay", "by_") else dx)).alias(c) for c in ("ay", "ax", "by_", "bx")])


def segment_crossings(left, right, size=1e6, size_x=1e5):
    """Pairs of segments that cross in their interiors, with the crossing point."""
    pairs = sp.segment_pairs(left, right, size, size_x)
    for p in "lr":
        for e, (y, x) in (("a", ("ay", "ax")), ("b", ("by_", "bx"))):
            pairs = pairs.withColumn(f"{p}{e}", g.vec(F.col(f"{p}_{y}") / 1e7, F.col(f"{p}_{x}") / 1e7))
    a, b, c, d = (F.col(x) for x in ("la", "lb", "ra", "rb"))
    return pairs.filter(g.arcs_cross(a, b, c, d)).withColumn("p", g.crossing(a, b, c, d))


@query("J12_segment_intersections", with_("redges") + """, r2 AS (SELECT rid, seq, ay+300000 ay, ax+30000 ax, by_+300000 by_, bx+30000 bx FROM redges)
  SELECT l.rid AS l_rid, l.seq AS l_seq, r.rid AS r_rid, r.seq AS r_seq FROM redges l JOIN r2 r ON greatest(least(l.ay,l.by_),least(r.ay,r.by_)) <= least(greatest(l.ay,l.by_),greatest(r.ay,r.by_))
  AND greatest(least(l.ax,l.bx),least(r.ax,r.bx)) <= least(greatest(l.ax,l.bx),greatest(r.ax,r.bx))
  AND ((l.ay=l.by_ AND r.ax=r.bx AND r.ax > least(l.ax,l.bx) AND r.ax < greatest(l.ax,l.bx) AND l.ay > least(r.ay,r.by_) AND l.ay < greatest(r.ay,r.by_))
  OR (l.ax=l.bx AND r.ay=r.by_ AND l.ax > least(r.ax,r.bx) AND l.ax < greatest(r.ax,r.bx) AND r.ay > least(l.ay,l.by_) AND r.ay < greatest(l.ay,l.by_)))""")
def j12(spark, sf):
    shapes, members = rg.by_shape(fx.rings(spark, sf))
    e = sp.ring_edges(shapes)
    return rg.told(segment_crossings(e, _shifted(e)).select("l_rid", "l_seq", "r_rid", "r_seq"), members, "l_rid", "r_rid").select("l_rid", "l_seq", "r_rid", "r_seq")


@query("W18_path_progress", with_("paths") + PSEG + """, cum AS (SELECT id, seq, w, sum(w) OVER (PARTITION BY id ORDER BY seq) reach, sum(w) OVER (PARTITION BY id) total FROM plen)
  SELECT id, seq, round(reach*6371,2) AS km, round(reach/total,6) AS part, reach - w < 0.4*total AS begun FROM cum""")
def w18(spark, sf):
    w = Window.partitionBy("id")
    cum = path_segments(spark, sf).withColumn("reach", F.sum("w").over(w.orderBy("seq"))).withColumn("total", F.sum("w").over(w))
    return cum.select("id", "seq", F.round(F.col("reach") * g.EARTH_KM, 2).alias("km"), F.round(F.col("reach") / F.col("total"), 6).alias("part"), (F.col("reach") - F.col("w") < 0.4 * F.col("total")).alias("begun"))


@query("W19_resample", with_("paths") + PSEG + """, cum AS (SELECT *, sum(w) OVER (PARTITION BY id ORDER BY seq) reach, sum(w) OVER (PARTITION BY id) total FROM plen),
  q AS (SELECT *, unnest(generate_series(CAST(floor((reach-w)/total*16.0) AS BIGINT)+1, CAST(floor(reach/total*16.0) AS BIGINT))) kk FROM cum), s AS (SELECT *, (kk/16.0*total-(reach-w))/w u FROM q WHERE kk < 16)
  SELECT id, kk AS k, round((x*sin((1-u)*w)+nx*sin(u*w))/sin(w),5) AS x, round((y*sin((1-u)*w)+ny*sin(u*w))/sin(w),5) AS y, round((z*sin((1-u)*w)+nz*sin(u*w))/sin(w),5) AS z FROM s WHERE kk > 0""")
def w19(spark, sf):
    w = Window.partitionBy("id")
    cum = path_segments(spark, sf).withColumn("reach", F.sum("w").over(w.orderBy("seq"))).withColumn("total", F.sum("w").over(w))
    lo, hi = F.floor((F.col("reach") - F.col("w")) / F.col("total") * 16.0) + 1, F.floor(F.col("reach") / F.col("total") * 16.0)
    q = cum.withColumn("k", F.explode(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>")))).filter("k > 0 AND k < 16")
    u = (F.col("k") / 16.0 * F.col("total") - (F.col("reach") - F.col("w"))) / F.col("w")
    return q.select("id", "k", g.slerp(F.col("v"), F.col("n"), u).alias("p")).select("id", "k", *[F.round(f"p.{c}", 5).alias(c) for c in "xyz"])


@query("W20_densify", with_("paths") + PSEG + """, d AS (SELECT *, CAST(ceil(w/0.5) AS BIGINT) pieces FROM plen), q AS (SELECT *, unnest(generate_series(0, pieces-1)) kk FROM d)
  SELECT id, seq, kk AS k, round((x*sin((1-kk*1.0/pieces)*w)+nx*sin(kk*1.0/pieces*w))/sin(w),5) AS x, round((z*sin((1-kk*1.0/pieces)*w)+nz*sin(kk*1.0/pieces*w))/sin(w),5) AS z FROM q""")
def w20(spark, sf):
    d = path_segments(spark, sf).withColumn("pieces", F.ceil(F.col("w") / 0.5)).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    return d.select("id", "seq", "k", g.slerp(F.col("v"), F.col("n"), F.col("k") * 1.0 / F.col("pieces")).alias("p")).select("id", "seq", "k", F.round("p.x", 5).alias("x"), F.round("p.z", 5).alias("z"))


@query("F13_whole_sphere_sentinel", with_("rvec") + """SELECT rid, count(*) <= 5 AND (SELECT min(a.x*b.x+a.y*b.y+a.z*b.z) FROM rvec a JOIN rvec b ON a.rid = b.rid WHERE a.rid = r.rid) < -0.99 AS sentinel FROM rvec r GROUP BY 1""")
def f13(spark, sf):
    vs = F.collect_list("v")
    low = F.array_min(F.flatten(F.transform(F.col("vs"), lambda a: F.transform(F.col("vs"), lambda b: g.dot(a, b)))))
    small = ring_vectors(spark, sf).groupBy("rid").agg(F.count("*").alias("n"), vs.alias("vs"))
    return small.select("rid", ((F.col("n") <= 5) & F.when(F.col("n") <= 5, low < -0.99).otherwise(F.lit(False))).alias("sentinel"))
