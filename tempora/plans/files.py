"""Queries on sources and sinks (S1-S21); their files are written by Spark from the tables into the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tempora.functions.names import content_id
from tempora.functions.sets import set_text
from tempora.functions.timeaxis import epoch_of
from tempora.operators import intervals as iv
from tempora.operators import spatial as sp
from tempora.plans import fixtures as fx
from tempora.plans.catalog import query
from tempora.plans.fixtures import T1, T2, with_
from tempora.plans.scratch import shared_root
from tempora.plans.spatial import PSEG, path_segments
from tempora.plans.temporal import TURNS, turns, verbs
from tempora.sources import geojson, raster, store
from tempora.sources.tables import table

C = F.col


def fresh(spark, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@query("S1_geojson_polygons", with_("rings") + """SELECT 'ring ' || rid AS name, 0 AS polygon, 0 AS ring, seq, round(qlat/1e7, 7) AS lat, round(qlon/1e7, 7) AS lon FROM rings
  UNION ALL SELECT 'ring ' || rid, 0, 0, 8, round(qlat/1e7, 7), round(qlon/1e7, 7) FROM rings WHERE seq = 0""")
def s1(spark, sf):
    path = fresh(spark, "geojson")
    geojson.collections(fx.rings(spark, sf), F.floor(C("rid") / 64)).select("value").write.text(path)
    rows = geojson.read_polygons(spark, path)
    return rows.select("name", "polygon", "ring", "seq", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"))


@query("S2_epoch_files", "SELECT CASE WHEN year(o_orderdate) % 2 = 1 THEN -year(o_orderdate) ELSE year(o_orderdate) END AS epoch, count(*) AS n FROM orders GROUP BY 1")
def s2(spark, sf):
    path = fresh(spark, "epochs")
    y = F.year("o_orderdate")
    named = table(spark, sf, "orders").select("o_orderkey", F.when(y % 2 == 1, F.concat(F.lit("world_bc"), y)).otherwise(F.concat(F.lit("world_"), y)).alias("file"))
    named.write.partitionBy("file").json(path)
    rows = spark.read.schema("o_orderkey long").json(f"{path}/*/").withColumn("name", F.col("_metadata.file_path"))
    return rows.groupBy(epoch_of(F.regexp_extract("name", "(world_(?:bc)?[0-9]+)", 1)).alias("epoch")).agg(F.count("*").alias("n"))


@query("S3_typed_rows_and_missing_fields", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN json_extract_string(props, '$.name') IS NULL THEN 'name' END AS missing FROM events")
def s3(spark, sf):
    p = F.from_json("props", "k long, name string")
    missing = F.when(p["k"].isNull(), "k").when(p["name"].isNull(), "name")
    return table(spark, sf, "events").select("event_id", p["k"].alias("k"), missing.alias("missing"))


@query("S4_nested_witnesses", "SELECT l_orderkey AS event, l_returnflag AS book, l_suppkey AS verse FROM lineitem")
def s4(spark, sf):
    path = fresh(spark, "journeys")
    groups = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.array(F.struct(F.collect_list("l_suppkey").alias("verses"))).alias("verse_groups"))
    groups.groupBy(C("l_orderkey").alias("event")).agg(F.collect_list(F.struct(C("l_returnflag").alias("book"), "verse_groups")).alias("witnesses")).write.json(path)
    ev = spark.read.schema("event long, witnesses array<struct<book:string,verse_groups:array<struct<verses:array<long>>>>>").json(path)
    w = ev.select("event", F.explode("witnesses").alias("w"))
    return w.select("event", "w.book", F.explode(F.flatten(F.transform("w.verse_groups", lambda g: g["verses"]))).alias("verse"))


@query("S5_landmarks", "SELECT s_name AS name, s_nationkey AS kind, ((s_suppkey*7919) % 17800)/100.0 - 89 AS lat FROM supplier")
def s5(spark, sf):
    path = fresh(spark, "landmarks")
    table(spark, sf, "supplier").select(C("s_name").alias("name"), C("s_nationkey").alias("kind"), (((C("s_suppkey") * 7919) % 17800) / 100.0 - 89).alias("lat")).write.json(path)
    return spark.read.schema("name string, kind int, lat double").json(path)


@query("S6_exports_of_one_root", "SELECT o_orderkey AS id, o_orderpriority AS basis, 1 AS format_version FROM orders")
def s6(spark, sf):
    path = fresh(spark, "exports")
    o = table(spark, sf, "orders")
    o.select(F.lit(1).alias("format_version"), F.lit("root").alias("root"), C("o_orderkey").alias("id"), C("o_orderpriority").alias("basis")).write.json(path + "/chronology")
    table(spark, sf, "supplier").select(F.lit(1).alias("format_version"), F.lit("root").alias("root"), C("s_suppkey").alias("id")).write.json(path + "/gazetteer")
    chronology = spark.read.schema("format_version int, root string, id long, basis string").json(path + "/chronology")
    gazetteer = spark.read.schema("format_version int, root string, id long").json(path + "/gazetteer")
    roots = F.broadcast(gazetteer.agg(F.min("root").alias("a"), F.max("root").alias("b")))  # one row
    same = (C("a") == C("root")) & (C("b") == C("root")) & (C("format_version") == 1)
    return chronology.join(roots).select("id", "basis", F.when(same, C("format_version")).otherwise(F.raise_error(F.lit("exports of two roots or versions")).cast("int")).alias("format_version"))


@query("S7_declared_counts", with_("rings") + "SELECT rid // 64 AS part, count(DISTINCT rid) AS features, count(DISTINCT rid) AS declared FROM rings GROUP BY 1")
def s7(spark, sf):
    path = fresh(spark, "pinned")
    geojson.collections(fx.rings(spark, sf), F.floor(C("rid") / 64)).write.partitionBy("part").text(path)
    files = spark.read.schema(geojson.COLLECTION + ", part long").json(path)
    return files.select("part", F.size("features").cast("long").alias("features"), C("expected_features").cast("long").alias("declared"))


@query("S8_networks_by_length", with_("paths") + PSEG + ", k AS (SELECT id, seq, sum(w) OVER (PARTITION BY id)*6371 km FROM plen), h AS (SELECT avg(km) km FROM k) SELECT k.id, k.seq FROM k, h WHERE k.km >= h.km")
def s8(spark, sf):
    k = path_segments(spark, sf).select("id", "seq", (F.sum("w").over(Window.partitionBy("id")) * 6371.0).alias("km"))
    least = F.broadcast(k.agg(F.avg("km").alias("least")))  # one row
    return k.join(least).filter("km >= least").select("id", "seq")


@query("S9_lakes_by_name_and_frame", with_("geo") + "SELECT k FROM geo JOIN customer ON c_custkey = k WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND lat BETWEEN -30 AND 45 AND lon BETWEEN -20 AND 90")
def s9(spark, sf):
    named = table(spark, sf, "customer").filter(C("c_mktsegment").isin("BUILDING", "MACHINERY")).select(C("c_custkey").alias("k"))
    return fx.geo(spark, sf).filter(C("lat").between(-30, 45) & C("lon").between(-20, 90)).join(named, "k").select("k")


@query("S10_waters_merged", """WITH q AS (SELECT l_orderkey f, CASE WHEN l_linenumber % 3 = 0 THEN 'unnamed water' ELSE l_shipdate::DATE::VARCHAR END AS name, count(*) n FROM lineitem GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (ORDER BY n DESC, f, name) rn FROM q) SELECT name, count(*) AS parts, sum(n) AS vertices FROM r WHERE rn > 1 GROUP BY 1""")
def s10(spark, sf):
    """Files united, unnamed ones labelled, the feature with most vertices left out, equal names merged."""
    name = F.when(C("l_linenumber") % 3 == 0, "unnamed water").otherwise(F.to_date("l_shipdate").cast("string"))
    q = table(spark, sf, "lineitem").groupBy(C("l_orderkey").alias("f"), name.alias("name")).agg(F.count("*").alias("n"))
    top = F.broadcast(q.agg(F.max(F.struct("n", (-C("f")).alias("f"))).alias("m")).select("m.n", (-C("m.f")).alias("f")))  # one row
    first = F.broadcast(q.join(top, ["n", "f"]).groupBy("n", "f").agg(F.min("name").alias("name")))
    return q.join(first, ["n", "f", "name"], "left_anti").groupBy("name").agg(F.count("*").alias("parts"), F.sum("n").alias("vertices"))


@query("S11_ocean_from_land", with_("rings") + "SELECT role, rid, seq FROM rings, (VALUES ('hole'), ('land')) r(role)")
def s11(spark, sf):
    """Land rings twice: as holes of the whole-sphere ocean and as dry land."""
    return fx.rings(spark, sf).select(F.explode(F.array(F.lit("hole"), F.lit("land"))).alias("role"), "rid", "seq")


@query("S12_elevation_raster", with_("grid") + "SELECT i, j, v FROM grid")
def s12(spark, sf):
    """The grid as files of 16-bit cells, eight rows each, read back by byte ranges; cells that no part stands for are NODATA."""
    path = fresh(spark, "raster")
    raster.write_grid(fx.grid(spark, sf), path, 50, 8)
    cells = raster.read_grid(spark, path, 50, 8).filter(C("v") != raster.NODATA)
    return cells.select((F.substring("file", 1, 8).cast("long") * 8 + C("i")).alias("i"), "j", C("v").cast("long").alias("v"))


@query("S13_store_write", with_("standings") + "SELECT layer, count(*) AS n FROM standings GROUP BY 1")
def s13(spark, sf):
    path = fresh(spark, "store")
    store.write_store(fx.standings(spark, sf), path)
    return store.read_store(spark, path).groupBy("layer").agg(F.count("*").alias("n"))


@query("S14_store_read_verified", with_("standings") + """SELECT sha256(length(layer) || ':' || layer || '|' || length(e::VARCHAR) || ':' || e || '|' || length(name) || ':' || name || '|' || length(f::VARCHAR) || ':' || f || '|' || length(u::VARCHAR) || ':' || u) AS id, e, f FROM standings""")
def s14(spark, sf):
    path = fresh(spark, "store")
    store.write_store(fx.standings(spark, sf), path)
    return store.verified_store(spark, path).select("id", "e", "f")


@query("S15_pinned_manifest", """WITH leaf AS (SELECT o_orderpriority f, o_orderkey // 4096 a, count(*) n, sha256(string_agg(sha256(o_orderkey::VARCHAR), '' ORDER BY o_orderkey)) h FROM orders GROUP BY 1, 2),
  node AS (SELECT f, a // 4096 a, sum(n) n, sha256(string_agg(h, '' ORDER BY a)) h FROM leaf GROUP BY 1, leaf.a // 4096)
  SELECT f AS file, CAST(sum(n) AS BIGINT) AS rows_, sha256(string_agg(h, '' ORDER BY a)) AS pin FROM node GROUP BY 1""")
def s15(spark, sf):
    """One pin a source file: a tree of hashes over ranges of 4096 keys, then of 4096 ranges, so that no group grows with the file."""
    o = table(spark, sf, "orders").select(C("o_orderpriority").alias("file"), C("o_orderkey").alias("a"), F.lit(1).alias("n"), F.sha2(C("o_orderkey").cast("string"), 256).alias("h"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", "h"))), lambda x: x["h"]), "")
    for part in (F.floor(C("a") / 4096), F.floor(C("a") / 4096), F.lit(0)):
        o = o.groupBy("file", part.alias("b")).agg(F.sum("n").alias("n"), F.sha2(text, 256).alias("h")).select("file", C("b").alias("a"), "n", "h")
    return o.select("file", C("n").alias("rows_"), C("h").alias("pin"))


@query("S16_geojson_export", with_("rings") + """, p AS (SELECT rid, string_agg('[' || qlon || ',' || qlat || ']', ',' ORDER BY seq) || ',[' || arg_min(qlon, seq) || ',' || arg_min(qlat, seq) || ']' AS pts FROM rings GROUP BY 1)
  SELECT rid, '{"type":"Feature","id":' || rid || ',"geometry":{"type":"Polygon","coordinates":[[' || pts || ']]},"properties":{"name":"' || c_name || '","layer":"' || c_mktsegment || '"},"attribution":["' || n_name || '"]}' AS feature
  FROM p JOIN customer ON c_custkey = rid JOIN nation ON n_nationkey = c_nationkey""")
def s16(spark, sf):
    """Features with closed geometry (units of 1e-7 degree), properties and attribution, one a line."""
    pts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "qlon", "qlat"))), lambda p: F.array(p["qlon"], p["qlat"]))
    r = fx.rings(spark, sf).groupBy("rid").agg(pts.alias("p")).withColumn("p", F.concat("p", F.slice("p", 1, 1)))
    names = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), C("c_nationkey") == C("n_nationkey")).select(C("c_custkey").alias("rid"), "c_name", "c_mktsegment", "n_name")
    feature = F.struct(F.lit("Feature").alias("type"), C("rid").alias("id"), F.struct(F.lit("Polygon").alias("type"), F.array("p").alias("coordinates")).alias("geometry"),
                       F.struct(C("c_name").alias("name"), C("c_mktsegment").alias("layer")).alias("properties"), F.array("n_name").alias("attribution"))
    return r.join(names, "rid").select("rid", F.to_json(feature).alias("feature"))


@query("S17_transition_json", with_("bodies") + TURNS + f"""SELECT '{{"verb":"' || verb || '","subject":' || e || CASE WHEN others IS NULL THEN '' ELSE ',"others":[' || others || ']' END || ',"at":' || t || '}}' AS step
  FROM plan WHERE t > {T1} AND t <= {T2}""")
def s17(spark, sf):
    """Every step of a transition plan as JSON; a split has its children with it, a merge its parents."""
    span = turns(spark, sf).filter(f"t > {T1} AND t <= {T2}")
    others = F.transform(F.split("others", ","), lambda x: x.cast("long"))
    return span.select(F.to_json(F.struct(verbs(C("kind")).alias("verb"), C("e").alias("subject"), others.alias("others"), C("t").alias("at"))).alias("step"))


@query("S18_query_batch", with_("standings") + """, q AS (SELECT DISTINCT year(o_orderdate)*12+6 t, 'layer=' || c_mktsegment || '&t=' || (year(o_orderdate)*12+6) AS text, c_mktsegment l FROM orders JOIN customer ON c_custkey = o_custkey)
  SELECT sha256(q.text) AS artifact, q.text, count(s.e) AS rows_ FROM q LEFT JOIN standings s ON s.layer = q.l AND s.f <= q.t AND q.t < s.u GROUP BY 1, 2""")
def s18(spark, sf):
    """A table of canonical queries (sorted parameters) answered in one job: artifact name, query, number of rows."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), C("o_custkey") == C("c_custkey"))
    q = o.select((F.year("o_orderdate") * 12 + 6).cast("long").alias("t"), C("c_mktsegment").alias("l")).distinct()
    text = F.concat(F.lit("layer="), C("l"), F.lit("&t="), C("t"))
    held = iv.instants_within(q, fx.standings(spark, sf)).filter("layer = l").groupBy("l", "t").agg(F.count("*").alias("n"))
    return q.join(held, ["l", "t"], "left").select(F.sha2(text, 256).alias("artifact"), text.alias("text"), F.coalesce("n", F.lit(0)).alias("rows_"))


@query("S19_violation_report", """SELECT 'price' AS law, count(*) AS n FROM orders WHERE o_totalprice < 2000 UNION ALL SELECT 'discount', count(*) FROM lineitem WHERE l_discount > 0.09 UNION ALL SELECT 'balance', count(*) FROM customer WHERE c_acctbal < 0""")
def s19(spark, sf):
    law = lambda name, t, cond: table(spark, sf, t).filter(cond).select(F.lit(name).alias("law"))
    every = law("price", "orders", "o_totalprice < 2000").union(law("discount", "lineitem", "l_discount > 0.09")).union(law("balance", "customer", "c_acctbal < 0"))
    return every.groupBy("law").agg(F.count("*").alias("n"))


@query("S20_name_book", "SELECT c_custkey AS k, CASE WHEN n_nationkey < 5 THEN 'exact ' || n_name WHEN n_name LIKE 'A%' THEN 'prefix A' ELSE n_name END AS display FROM customer JOIN nation ON n_nationkey = c_nationkey")
def s20(spark, sf):
    n = table(spark, sf, "nation")
    book = n.filter("n_nationkey < 5").select("n_name", F.concat(F.lit("exact "), C("n_name")).alias("exact"))
    shown = n.join(book, "n_name", "left").select("n_nationkey", F.coalesce("exact", F.when(C("n_name").startswith("A"), "prefix A").otherwise(C("n_name"))).alias("display"))
    return table(spark, sf, "customer").join(shown, C("c_nationkey") == C("n_nationkey")).select(C("c_custkey").alias("k"), "display")


@query("S21_geometry_manifest", "SELECT sha256(length(o_orderstatus) || ':' || o_orderstatus || '|' || length(o_custkey::VARCHAR) || ':' || o_custkey) AS resource, count(*) AS refs, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS styles FROM orders GROUP BY 1")
def s21(spark, sf):
    o = table(spark, sf, "orders").select(content_id(C("o_orderstatus"), C("o_custkey")).alias("resource"), "o_orderpriority")
    return o.groupBy("resource").agg(F.count("*").alias("refs"), set_text("o_orderpriority").alias("styles"))
