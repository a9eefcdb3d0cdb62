"""Views over the driver's tables that stand in for the domain's inputs, in Spark and, under the same names, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.operators.intervals import islands, versions_on_change
from tempora.sources.tables import table

T1, T2 = 23970, 23982  # two instants (months) inside the data

CTE = {
    "months": "months AS (SELECT DISTINCT o_custkey e, year(o_orderdate)*12+month(o_orderdate) t FROM orders)",
    "standings": """runs AS (SELECT e, t, t - row_number() OVER (PARTITION BY e ORDER BY t) g FROM months),
      spans AS (SELECT e, min(t) f, max(t)+1 u FROM runs GROUP BY e, g),
      standings AS (SELECT c_mktsegment layer, e, c_name AS name, f, u FROM spans JOIN customer ON c_custkey = e)""",
    "stated": "stated AS (SELECT o_custkey e, year(o_orderdate)*12+month(o_orderdate) t, arg_max(o_orderstatus, o_orderkey) st FROM orders GROUP BY 1, 2)",
    "versions": """firsts AS (SELECT e, t f, st FROM (SELECT *, lag(st) OVER (PARTITION BY e ORDER BY t) b FROM stated) WHERE b IS NULL OR b <> st),
      versions AS (SELECT e, st, f, lead(f) OVER (PARTITION BY e ORDER BY f) u FROM firsts)""",
    "bodies": """bruns AS (SELECT e, st, t, t - row_number() OVER (PARTITION BY e, st ORDER BY t) g FROM stated),
      bodies AS (SELECT e, st, min(t) f, max(t)+1 u FROM bruns GROUP BY e, st, g)""",
    "geo": """geo AS (SELECT k, ((k*7919) % 17800)/100.0-89 lat, ((k*104729) % 36000)/100.0-180 lon FROM (SELECT c_custkey k FROM customer)),
      vec AS (SELECT k, lat, lon, cos(radians(lat))*cos(radians(lon)) x, cos(radians(lat))*sin(radians(lon)) y, sin(radians(lat)) z FROM geo)""",
    "pip": "pip AS (SELECT c_custkey k, (c_custkey*7919123) % 160000000 - 80000000 + 13 y, (c_custkey*104729017) % 20000000 + 100000000 + 17 x FROM customer)",
    "rings": """cellsof AS (SELECT c_custkey rid, (c_custkey // 100 % 80)*2000000 - 80000000 oy, (c_custkey % 100)*200000 + 100000000 ox FROM customer),
      rings AS (SELECT rid, s.seq, oy + s.dy*1000000 qlat, ox + s.dx*100000 qlon FROM cellsof, (VALUES (0,0,0),(1,0,1),(2,0,2),(3,1,2),(4,2,2),(5,2,1),(6,2,0),(7,1,0)) s(seq,dy,dx))""",
    "rvec": """rvec AS (SELECT rid, seq, qlat, qlon, cos(radians(qlat/1e7))*cos(radians(qlon/1e7)) x, cos(radians(qlat/1e7))*sin(radians(qlon/1e7)) y, sin(radians(qlat/1e7)) z FROM rings)""",
    "redges": """redges AS (SELECT rid, seq, qlat ay, qlon ax, coalesce(lead(qlat) OVER w, first_value(qlat) OVER w) AS by_, coalesce(lead(qlon) OVER w, first_value(qlon) OVER w) AS bx
      FROM rings WINDOW w AS (PARTITION BY rid ORDER BY seq))""",
    "paths": """paths AS (SELECT user_id id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) seq, event_id,
      ((event_id*7919123) % 1200000000 - 600000000)/1e7 lat, ((event_id*104729017) % 3400000000 - 1700000000)/1e7 lon FROM events),
      pvec AS (SELECT *, cos(radians(lat))*cos(radians(lon)) x, cos(radians(lat))*sin(radians(lon)) y, sin(radians(lat)) z FROM paths)""",
    "grid": "grid AS (SELECT p_partkey // 50 i, p_partkey % 50 j, (p_size*137) % 1000 v FROM part)",
    "edges": "edges AS (SELECT c_custkey a, c_custkey // 12 * 12 + (c_custkey*c_custkey+7) % 12 b FROM customer)",
    "presence": "presence AS (SELECT user_id who, min(event_id) f, max(event_id)+1 u FROM events GROUP BY 1)",
    "steps": """steps AS (SELECT user_id e, event_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) seq FROM events)""",
}
NEEDS = {"standings": ["months"], "versions": ["stated"], "bodies": ["stated"], "rvec": ["rings"], "redges": ["rings"]}


def with_(*names: str) -> str:
    """WITH clause that defines the named views."""
    order: list[str] = []
    for n in names:
        for x in (*NEEDS.get(n, []), n):
            if x not in order:
                order.append(x)
    return "WITH " + ", ".join(CTE[x] for x in order) + " "


def month(c) -> F.Column:
    return (F.year(c) * 12 + F.month(c)).cast("long")


def months(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("e"), month("o_orderdate").alias("t")).distinct()


def standings(spark, sf) -> DataFrame:
    """layer, e, name, f, u: months in which a customer orders, as intervals."""
    names = table(spark, sf, "customer").select(F.col("c_custkey").alias("e"), F.col("c_mktsegment").alias("layer"), F.col("c_name").alias("name"))
    return islands(months(spark, sf), ["e"]).join(names, "e").select("layer", "e", "name", "f", "u")


def stated(spark, sf) -> DataFrame:
    """e, t, st: a customer's latest order status of a month."""
    o = table(spark, sf, "orders")
    return o.groupBy(F.col("o_custkey").alias("e"), month("o_orderdate").alias("t")).agg(F.max_by("o_orderstatus", "o_orderkey").alias("st"))


def versions(spark, sf) -> DataFrame:
    return versions_on_change(stated(spark, sf), ["e"], "t", "st")


def bodies(spark, sf) -> DataFrame:
    return islands(stated(spark, sf), ["e", "st"])


def geo(spark, sf) -> DataFrame:
    k = F.col("k")
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).select(
        "k", (((k * 7919) % 17800) / 100.0 - 89).alias("lat"), (((k * 104729) % 36000) / 100.0 - 180).alias("lon"))


def pip(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("k"), ((k * 7919123) % 160000000 - 80000000 + 13).alias("y"), ((k * 104729017) % 20000000 + 100000000 + 17).alias("x"))


def rings(spark, sf) -> DataFrame:
    """rid, seq, qlat, qlon: one eight-vertex ring a customer in a grid of touching cells, counter-clockwise, units of 1e-7 degree."""
    k = F.col("c_custkey")
    corners = [(0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 1, 2), (4, 2, 2), (5, 2, 1), (6, 2, 0), (7, 1, 0)]
    oy, ox = (F.floor(k / 100) % 80) * 2000000 - 80000000, (k % 100) * 200000 + 100000000
    vs = F.array(*[F.struct(F.lit(s).cast("long").alias("seq"), (oy + dy * 1000000).alias("qlat"), (ox + dx * 100000).alias("qlon")) for s, dy, dx in corners])
    return table(spark, sf, "customer").select(k.alias("rid"), F.explode(vs).alias("v")).select("rid", "v.seq", "v.qlat", "v.qlon")


def paths(spark, sf) -> DataFrame:
    e = F.col("event_id")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("id"), F.row_number().over(w).cast("long").alias("seq"), "event_id",
        (((e * 7919123) % 1200000000 - 600000000) / 1e7).alias("lat"), (((e * 104729017) % 3400000000 - 1700000000) / 1e7).alias("lon"))


def grid(spark, sf) -> DataFrame:
    p = F.col("p_partkey")
    return table(spark, sf, "part").select(F.floor(p / 50).alias("i"), (p % 50).alias("j"), ((F.col("p_size") * 137) % 1000).alias("v"))


def graph_edges(spark, sf) -> DataFrame:
    """One edge a customer, to another key of its dozen: many components."""
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("a"), (F.floor(k / 12) * 12 + (k * k + 7) % 12).alias("b"))


def presence(spark, sf) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("who")).agg(F.min("event_id").alias("f"), (F.max("event_id") + 1).alias("u"))


def steps(spark, sf) -> DataFrame:
    """e, event_id, ts, event_type, seq: a user's events in order, the stations of a journey."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select(F.col("user_id").alias("e"), "event_id", "ts", "event_type", F.row_number().over(w).cast("long").alias("seq"))
