"""Queries that compose scenes: selection, styling, ordering, unions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tempora.functions import names as nm
from tempora.functions import timeaxis as ta
from tempora.functions.sets import set_text
from tempora.operators import intervals as iv
from tempora.plans import fixtures as fx
from tempora.plans.catalog import query
from tempora.plans.fixtures import T1, with_
from tempora.sources.tables import table

C = F.col
PIECES = ("land", "water", "borders", "routes", "places", "labels", "relief", "rivers", "frame", "notes")
AT1 = f"f <= {T1} AND (u IS NULL OR {T1} < u)"
LAYERS = [("AUTOMOBILE", 1, 5, 0.8), ("BUILDING", 2, 6, 1.0), ("FURNITURE", 3, 24, 0.6), ("HOUSEHOLD", 4, 96, 0.4), ("MACHINERY", 5, 640, 0.2)]
LAYER_SQL = "layers(layer, rank, mask, alpha) AS (VALUES " + ", ".join(f"('{a}', {b}, {c}, {d})" for a, b, c, d in LAYERS) + ")"


def layers(spark):
    """The style dimension: one row a layer."""
    return F.broadcast(spark.createDataFrame(LAYERS, "layer string, rank long, mask long, alpha double"))


def cust(spark, sf):
    return table(spark, sf, "customer")


@query("P1_piece_restriction", "SELECT c_custkey AS k, CAST(1 << (c_custkey % 10) AS BIGINT) AS piece FROM customer WHERE ((1 << (c_custkey % 10)) & 150) <> 0")
def p1(spark, sf):
    piece = F.expr("shiftleft(1L, cast(c_custkey % 10 as int))")
    return cust(spark, sf).select(C("c_custkey").alias("k"), piece.alias("piece")).filter(C("piece").bitwiseAND(150) != 0)


@query("P2_layer_pruning", with_("standings")[:-1] + ", " + LAYER_SQL + " SELECT layer, count(*) AS n FROM standings JOIN layers USING (layer) WHERE (mask & 28) <> 0 GROUP BY 1")
def p2(spark, sf):
    wanted = layers(spark).filter(C("mask").bitwiseAND(28) != 0).select("layer")
    return fx.standings(spark, sf).join(F.broadcast(wanted), "layer", "left_semi").groupBy("layer").agg(F.count("*").alias("n"))


@query("P6_one_region_with_labels", """SELECT c_custkey AS k, c_name AS name, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS attribution
  FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 7 GROUP BY 1, 2""")
def p6(spark, sf):
    region = cust(spark, sf).filter("c_nationkey = 7").select(C("c_custkey").alias("k"), C("c_name").alias("name"))
    labels = table(spark, sf, "orders").select(C("o_custkey").alias("k"), "o_orderpriority")
    return region.join(labels, "k").groupBy("k", "name").agg(set_text("o_orderpriority").alias("attribution"))


@query("P7_source_selection", """SELECT c_custkey AS k, c_mktsegment AS layer FROM customer c WHERE c_mktsegment = 'MACHINERY' OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')""")
def p7(spark, sf):
    sources = table(spark, sf, "orders").groupBy(C("o_custkey").alias("k")).agg(F.collect_set(F.substring("o_orderpriority", 1, 1)).alias("src"))
    rows = cust(spark, sf).select(C("c_custkey").alias("k"), C("c_mktsegment").alias("layer")).join(sources, "k", "left")
    return rows.filter((C("layer") == "MACHINERY") | F.coalesce(F.arrays_overlap("src", F.array(F.lit("1"))), F.lit(False))).select("k", "layer")


@query("P8_stage_only", "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'MACHINERY'")
def p8(spark, sf):
    return cust(spark, sf).filter("c_mktsegment = 'MACHINERY'").select(C("c_custkey").alias("k"))


@query("P9_class_filter_and_drops", "SELECT c_custkey AS k, lower(replace(c_name, '#', '-')) AS slug FROM customer WHERE c_mktsegment <> 'FURNITURE' AND c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def p9(spark, sf):
    drops = table(spark, sf, "supplier").select(C("s_suppkey").alias("k"))
    rows = cust(spark, sf).filter("c_mktsegment <> 'FURNITURE'").select(C("c_custkey").alias("k"), F.lower(F.regexp_replace("c_name", "#", "-")).alias("slug"))
    return rows.join(drops, "k", "left_anti")


@query("P10_anchor_filter", with_("standings") + "SELECT layer, count(*) FILTER (f >= 23950) AS kept, count(*) FILTER (f < 23950) AS exempt FROM standings GROUP BY 1")
def p10(spark, sf):
    return fx.standings(spark, sf).groupBy("layer").agg(F.count_if(C("f") >= 23950).alias("kept"), F.count_if(C("f") < 23950).alias("exempt"))


@query("P12_tenure_projection", "SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'P' THEN 'claimed' ELSE 'held' END AS tenure, CASE o_orderstatus WHEN 'P' THEN 0.0 ELSE 0.85 END AS alpha, CASE o_orderstatus WHEN 'P' THEN 'dashed' ELSE 'solid' END AS stroke FROM orders")
def p12(spark, sf):
    claimed = C("o_orderstatus") == "P"
    return table(spark, sf, "orders").select(C("o_orderkey").alias("k"), F.when(claimed, "claimed").otherwise("held").alias("tenure"),
                                             F.when(claimed, 0.0).otherwise(0.85).alias("alpha"), F.when(claimed, "dashed").otherwise("solid").alias("stroke"))


@query("P13_style_resolution", "WITH " + LAYER_SQL + " SELECT c_custkey AS k, layer, rank, CAST(alpha AS DOUBLE) AS alpha, CASE WHEN c_acctbal < 0 THEN 'unknown' ELSE 'surveyed' END AS edge FROM customer JOIN layers ON layer = c_mktsegment")
def p13(spark, sf):
    rows = cust(spark, sf).select(C("c_custkey").alias("k"), C("c_mktsegment").alias("layer"), F.when(C("c_acctbal") < 0, "unknown").otherwise("surveyed").alias("edge"))
    return rows.join(layers(spark), "layer").select("k", "layer", "rank", "alpha", "edge")


@query("P14_age_ramp", with_("standings") + "SELECT e, f, CAST(round(20 + (f-23940)/100.0*180) AS BIGINT) AS red, CAST(round(200 - (f-23940)/100.0*150) AS BIGINT) AS blue FROM standings")
def p14(spark, sf):
    age = (C("f") - 23940) / 100.0
    return fx.standings(spark, sf).select("e", "f", F.round(20 + age * 180).cast("long").alias("red"), F.round(200 - age * 150).cast("long").alias("blue"))


@query("W10_claim_precedence", """WITH claims AS (SELECT l_partkey part, l_suppkey who, min(l_linenumber) depth, sum(l_quantity) area, min(CASE l_returnflag WHEN 'R' THEN 0 ELSE 1 END) land FROM lineitem GROUP BY 1, 2)
  SELECT part, who, land, CAST(rn AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY land, depth DESC, area, who) rn FROM claims)""")
def w10(spark, sf):
    c = table(spark, sf, "lineitem").groupBy(C("l_partkey").alias("part"), C("l_suppkey").alias("who")).agg(
        F.min("l_linenumber").alias("depth"), F.sum("l_quantity").alias("area"), F.min(F.when(C("l_returnflag") == "R", 0).otherwise(1)).alias("land"))
    w = Window.partitionBy("part").orderBy("land", C("depth").desc(), "area", "who")
    return c.select("part", "who", "land", F.row_number().over(w).cast("long").alias("place"))


@query("W11_first_claimant_present", """SELECT l_partkey AS part, min(l_suppkey) AS who FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY 1""")
def w11(spark, sf):
    absent = table(spark, sf, "supplier").filter("s_acctbal < 0").select(C("s_suppkey").alias("l_suppkey"))
    return table(spark, sf, "lineitem").join(absent, "l_suppkey", "left_anti").groupBy(C("l_partkey").alias("part")).agg(F.min("l_suppkey").alias("who"))


@query("W12_paint_order", "WITH " + LAYER_SQL + " SELECT c_custkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY rank, c_acctbal DESC, c_custkey) AS place FROM customer JOIN layers ON layer = c_mktsegment")
def w12(spark, sf):
    rows = cust(spark, sf).withColumnRenamed("c_mktsegment", "layer").join(layers(spark), "layer")
    w = Window.partitionBy("c_nationkey").orderBy("rank", C("c_acctbal").desc(), "c_custkey")
    return rows.select(C("c_custkey").alias("k"), F.row_number().over(w).cast("long").alias("place"))


@query("W13_listing_precedence", "SELECT o_custkey AS e, arg_min(o_orderkey, (o_orderpriority, o_orderkey)) AS chosen, min(o_orderpriority) AS layer FROM orders GROUP BY 1")
def w13(spark, sf):
    key = F.struct("o_orderpriority", "o_orderkey")
    return table(spark, sf, "orders").groupBy(C("o_custkey").alias("e")).agg(F.min_by("o_orderkey", key).alias("chosen"), F.min("o_orderpriority").alias("layer"))


@query("T1_scene_overlay", "SELECT c_custkey AS k, 0 AS ordinal FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT s_suppkey, 1 FROM supplier")
def t1(spark, sf):
    base = cust(spark, sf).filter("c_mktsegment = 'BUILDING'").select(C("c_custkey").alias("k"), F.lit(0).alias("ordinal"))
    return base.unionByName(table(spark, sf, "supplier").select(C("s_suppkey").alias("k"), F.lit(1).alias("ordinal")))


@query("J19_named_entities", "SELECT o_orderkey AS k FROM orders WHERE o_custkey IN (SELECT s_suppkey FROM supplier)")
def j19(spark, sf):
    named = table(spark, sf, "supplier").select(C("s_suppkey").alias("o_custkey"))
    return table(spark, sf, "orders").join(named, "o_custkey", "left_semi").select(C("o_orderkey").alias("k"))


@query("J20_backdrop_minus_realised", with_("standings") + f"SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT e FROM standings WHERE {AT1})")
def j20(spark, sf):
    done = iv.valid_at(fx.standings(spark, sf), T1).select(C("e").alias("c_custkey"))
    return cust(spark, sf).join(done, "c_custkey", "left_anti").select(C("c_custkey").alias("k"))


@query("A14_exemption_counts", "SELECT year(o_orderdate) AS epoch, count(*) FILTER (o_orderstatus = 'P') AS pending, count(*) FILTER (o_totalprice < 1000) AS small FROM orders GROUP BY 1")
def a14(spark, sf):
    return table(spark, sf, "orders").groupBy(F.year("o_orderdate").cast("long").alias("epoch")).agg(F.count_if(C("o_orderstatus") == "P").alias("pending"), F.count_if(C("o_totalprice") < 1000).alias("small"))


@query("A15_registry_merge", "SELECT l_partkey AS canonical, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS names, string_agg(l_suppkey || '/' || l_orderkey || '/' || l_linenumber, ',' ORDER BY l_suppkey, l_orderkey, l_linenumber) AS witnesses FROM lineitem GROUP BY 1")
def a15(spark, sf):
    item = F.struct("l_suppkey", "l_orderkey", "l_linenumber")
    text = F.transform(F.array_sort(F.collect_list(item)), lambda s: F.concat_ws("/", s["l_suppkey"], s["l_orderkey"], s["l_linenumber"]))
    return table(spark, sf, "lineitem").groupBy(C("l_partkey").alias("canonical")).agg(set_text("l_returnflag").alias("names"), F.array_join(text, ",").alias("witnesses"))


@query("A16_attribution_union", "SELECT c_mktsegment AS layer, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS sources FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def a16(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderpriority").distinct()
    return o.join(cust(spark, sf), C("o_custkey") == C("c_custkey")).groupBy(C("c_mktsegment").alias("layer")).agg(set_text("o_orderpriority").alias("sources"))


@query("A19_content_dedup", "SELECT id, min(o_orderkey) AS kept, count(*) AS copies FROM (SELECT o_orderkey, sha256(length(o_orderstatus) || ':' || o_orderstatus || '|' || length(o_orderpriority) || ':' || o_orderpriority || '|' || length(o_custkey::VARCHAR) || ':' || o_custkey) id FROM orders) GROUP BY 1")
def a19(spark, sf):
    ids = table(spark, sf, "orders").select("o_orderkey", nm.content_id(C("o_orderstatus"), C("o_orderpriority"), C("o_custkey")).alias("id"))
    return ids.groupBy("id").agg(F.min("o_orderkey").alias("kept"), F.count("*").alias("copies"))


@query("K2_top_one_or_none", """WITH c AS (SELECT l_partkey k, l_suppkey s, count(*) n FROM lineitem GROUP BY 1, 2), r AS (SELECT *, dense_rank() OVER (PARTITION BY k ORDER BY n DESC) d FROM c)
  SELECT k, CASE WHEN count(*) = 1 THEN min(s) END AS bound FROM r WHERE d = 1 GROUP BY 1""")
def k2(spark, sf):
    c = table(spark, sf, "lineitem").groupBy(C("l_partkey").alias("k"), C("l_suppkey").alias("s")).agg(F.count("*").alias("n"))
    top = c.withColumn("d", F.dense_rank().over(Window.partitionBy("k").orderBy(C("n").desc()))).filter("d = 1")
    return top.groupBy("k").agg(F.when(F.count("*") == 1, F.min("s")).alias("bound"))


@query("K3_top_violations", "SELECT l_orderkey AS k, l_linenumber AS n, l_discount AS d FROM lineitem WHERE l_discount > 0.09 ORDER BY l_orderkey, l_linenumber LIMIT 50")
def k3(spark, sf):
    return table(spark, sf, "lineitem").filter("l_discount > 0.09").select(C("l_orderkey").alias("k"), C("l_linenumber").alias("n"), C("l_discount").alias("d")).orderBy("k", "n").limit(50)


@query("K4_largest_of_group", "SELECT o_custkey AS e, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS largest FROM orders GROUP BY 1")
def k4(spark, sf):
    return table(spark, sf, "orders").groupBy(C("o_custkey").alias("e")).agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("largest"))


Y = "CASE WHEN y <= 0 THEN y - 1 ELSE y END"


@query("F7_years_and_dates", f"""WITH q AS (SELECT o_orderkey k, o_orderkey % 400 - 200 y, o_orderdate d FROM orders), z AS (SELECT k, {Y} y, d FROM q)
  SELECT k, y, CASE WHEN y = -1 THEN 1 ELSE y + 1 END AS next_, (CASE WHEN y < 0 THEN y + 1 ELSE y END) + 10 AS span, year(d)*10000 + month(d)*100 + day(d) AS key_, CASE WHEN y < 0 THEN 'world_bc' || -y ELSE 'world_' || y END AS file_, y AS epoch FROM z""")
def f7(spark, sf):
    q = C("o_orderkey") % 400 - 200
    y = F.when(q <= 0, q - 1).otherwise(q)
    rows = table(spark, sf, "orders").select(C("o_orderkey").alias("k"), y.alias("y"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("text"))
    name = F.when(C("y") < 0, F.concat(F.lit("world_bc"), -C("y"))).otherwise(F.concat(F.lit("world_"), C("y")))
    rows = rows.withColumn("file_", name)
    return rows.select("k", "y", ta.year_after(C("y")).alias("next_"), (ta.years_between(F.lit(1), C("y")) + 11).alias("span"),
                       ta.parsed_key(C("text")).alias("key_"), "file_", ta.epoch_of(C("file_")).alias("epoch"))


@query("F8_slugs_and_names", "SELECT c_custkey AS k, regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g') AS slug, regexp_replace(lower(c_name), '[\\s#-]+[0-9]+$', '') AS base FROM customer")
def f8(spark, sf):
    return cust(spark, sf).select(C("c_custkey").alias("k"), nm.slug(C("c_name")).alias("slug"), nm.base_name(C("c_name")).alias("base"))


@query("F9_locus_parse", "SELECT l_orderkey AS k, l_linenumber AS n, 'B' || (l_suppkey % 66) AS book, CAST(l_partkey % 50 AS INTEGER) AS chapter, CAST(l_orderkey % 30 AS INTEGER) AS verse FROM lineitem")
def f9(spark, sf):
    text = F.concat(F.lit("B"), C("l_suppkey") % 66, F.lit("."), C("l_partkey") % 50, F.lit("."), C("l_orderkey") % 30)
    return table(spark, sf, "lineitem").select(C("l_orderkey").alias("k"), C("l_linenumber").alias("n"), nm.locus(text).alias("x")).select("k", "n", "x.book", "x.chapter", "x.verse")


@query("F10_content_id", "SELECT c_custkey AS k, sha256(length(c_name) || ':' || c_name || '|' || length(c_nationkey::VARCHAR) || ':' || c_nationkey) AS id FROM customer")
def f10(spark, sf):
    return cust(spark, sf).select(C("c_custkey").alias("k"), nm.content_id(C("c_name"), C("c_nationkey")).alias("id"))


@query("F11_auto_detail", "SELECT p_partkey AS k, round(greatest(1e-6, least(0.01, radians(p_retailprice / 1000.0 / 960))), 9) AS detail, round(p_size * 1.8, 3) AS radius FROM part")
def f11(spark, sf):
    detail = F.greatest(F.lit(1e-6), F.least(F.lit(0.01), F.radians(C("p_retailprice") / 1000.0 / 960)))
    return table(spark, sf, "part").select(C("p_partkey").alias("k"), F.round(detail, 9).alias("detail"), F.round(C("p_size") * 1.8, 3).alias("radius"))


def pieces_mask(text):
    """Bit set of a comma-separated piece list; unknown names count nothing."""
    names = F.transform(F.split(text, ","), lambda n: F.trim(n))
    bits = F.create_map(*[x for i, p in enumerate(PIECES) for x in (F.lit(p), F.lit(1 << i))])
    return F.aggregate(names, F.lit(0), lambda acc, n: acc.bitwiseOR(F.coalesce(bits[n], F.lit(0))))


def pieces_text(mask):
    return F.concat_ws(",", *[F.when(mask.bitwiseAND(1 << i) != 0, p) for i, p in enumerate(PIECES)])


@query("F12_piece_sets", "SELECT p_partkey AS k, CAST(CASE WHEN p_size % 10 = (p_partkey % 10) THEN 1 << (p_size % 10) ELSE (1 << (p_size % 10)) | (1 << (p_partkey % 10)) END AS INTEGER) AS mask FROM part")
def f12(spark, sf):
    listed = F.array(*[F.lit(p) for p in PIECES])
    text = F.concat_ws(", ", F.get(listed, (C("p_size") % 10).cast("int")), F.get(listed, (C("p_partkey") % 10).cast("int")))
    mask = pieces_mask(text)
    return table(spark, sf, "part").select(C("p_partkey").alias("k"), pieces_mask(pieces_text(mask)).alias("mask"))
