"""Laws as queries that list violations, and identity resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions import names as nm
from tempora.operators import intervals as iv
from tempora.plans import fixtures as fx
from tempora.plans.catalog import ORACLE_SQL, QUERIES, query
from tempora.plans.fixtures import with_
from tempora.plans.shapes import DEPTH, OVERLAPS, standing_rings, territories_overlap, two_layers
from tempora.plans.scratch import materialize
from tempora.sources.tables import table

C = F.col


def missing(rows: DataFrame, ref: str, known: DataFrame, key: str) -> DataFrame:
    """Rows whose reference isn't known."""
    return rows.join(known.select(C(key).alias(ref)).distinct(), ref, "left_anti")


def incoherent(rows: DataFrame, key: list[str]) -> DataFrame:
    """law, key, f, u: intervals that are empty or begin before an earlier one of their key has ended."""
    w = Window.partitionBy(*key).orderBy("f", "u").rowsBetween(Window.unboundedPreceding, -1)
    r = rows.withColumn("reach", F.max("u").over(w))
    law = F.when(C("u") <= C("f"), "empty").when(C("reach") > C("f"), "overlap")
    return r.withColumn("law", law).filter("law IS NOT NULL").select("law", *key, "f", "u")


@query("L1_anchor", "SELECT o_orderkey AS k, year(o_orderdate)*12+month(o_orderdate) AS t FROM orders WHERE year(o_orderdate)*12+month(o_orderdate) < 23945")
def l1(spark, sf):
    return table(spark, sf, "orders").select(C("o_orderkey").alias("k"), fx.month("o_orderdate").alias("t")).filter("t < 23945")


@query("L2_history_coherence", """WITH h AS (SELECT o_custkey e, o_orderkey f, o_orderkey + (o_orderkey % 40)*5 u FROM orders),
  r AS (SELECT *, max(u) OVER (PARTITION BY e ORDER BY f, u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) reach FROM h)
  SELECT CASE WHEN u <= f THEN 'empty' ELSE 'overlap' END AS law, e, f, u FROM r WHERE u <= f OR reach > f
  UNION ALL SELECT 'unnarrated', e, f, u FROM h WHERE f NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def l2(spark, sf):
    k = C("o_orderkey")
    h = table(spark, sf, "orders").select(C("o_custkey").alias("e"), k.alias("f"), (k + (k % 40) * 5).alias("u"))
    told = table(spark, sf, "lineitem").filter("l_returnflag = 'R'")
    silent = missing(h, "f", told, "l_orderkey").select(F.lit("unnarrated").alias("law"), "e", "f", "u")
    return incoherent(h, ["e"]).unionByName(silent)


@query("L3_provenance", "SELECT p_partkey AS k FROM part WHERE trim(CASE WHEN p_partkey % 17 = 0 THEN '  ' ELSE p_name END) = ''")
def l3(spark, sf):
    note = F.when(C("p_partkey") % 17 == 0, "  ").otherwise(C("p_name"))
    return table(spark, sf, "part").filter(F.trim(note) == "").select(C("p_partkey").alias("k"))


@query("L5_authority_order", """SELECT 'date' AS law, l_orderkey AS k, l_linenumber AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE date_trunc('month', l_shipdate) < date_trunc('month', o_orderdate)
  UNION ALL SELECT 'driver', l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'waypoint', l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 20)""")
def l5(spark, sf):
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    cols = lambda law: (F.lit(law).alias("law"), C("l_orderkey").alias("k"), C("l_linenumber").alias("n"))
    date = li.join(o, C("l_orderkey") == C("o_orderkey")).filter(F.trunc("l_shipdate", "month") < F.trunc("o_orderdate", "month")).select(*cols("date"))
    driver = missing(li, "l_orderkey", o, "o_orderkey").select(*cols("driver"))
    way = missing(li, "l_suppkey", table(spark, sf, "supplier").filter("s_nationkey < 20"), "s_suppkey").select(*cols("waypoint"))
    return date.union(driver).union(way)


@query("L6_event_references", "SELECT DISTINCT l_orderkey AS k, ref FROM (SELECT l_orderkey, unnest([l_partkey, l_suppkey * 1000]) ref FROM lineitem) WHERE ref NOT IN (SELECT p_partkey FROM part)")
def l6(spark, sf):
    refs = table(spark, sf, "lineitem").select(C("l_orderkey").alias("k"), F.explode(F.array("l_partkey", C("l_suppkey") * 1000)).alias("ref"))
    return missing(refs, "ref", table(spark, sf, "part"), "p_partkey").select("k", "ref").distinct()


@query("L7_store_closure", with_("standings", "rings") + OVERLAPS + """SELECT 'snapshot' AS law, l_orderkey AS k FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL
  SELECT 'feature', o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > -900) UNION ALL SELECT 'backward', l_orderkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate < o_orderdate
  UNION ALL SELECT 'overlap', a FROM clashes""")
def l7(spark, sf):
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    a = missing(li, "l_orderkey", o, "o_orderkey").select(F.lit("snapshot").alias("law"), C("l_orderkey").alias("k"))
    b = missing(o, "o_custkey", table(spark, sf, "customer").filter("c_acctbal > -900"), "c_custkey").select(F.lit("feature"), C("o_orderkey"))
    c = li.join(o, C("l_orderkey") == C("o_orderkey")).filter("l_shipdate < o_orderdate").select(F.lit("backward"), C("l_orderkey"))
    d = territories_overlap(standing_rings(spark, sf), two_layers(spark, sf)[1], DEPTH).select(F.lit("overlap"), "a")
    return a.union(b).union(c).union(d)


@query("L8_frame_edge", with_("standings") + "SELECT e FROM standings WHERE u = (SELECT max(u) FROM standings) AND e NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def l8(spark, sf):
    st = fx.standings(spark, sf)
    edge = F.broadcast(st.agg(F.max("u").alias("edge")))  # one row
    marked = table(spark, sf, "customer").filter("c_acctbal > 5000").select(C("c_custkey").alias("e"))
    return st.join(edge, C("u") == C("edge")).select("e").join(marked, "e", "left_anti")


REG = "reg AS (SELECT o_orderkey minted, o_orderkey * 7 % 40000 canonical, o_orderstatus kind FROM orders)"


def registry(spark, sf):
    k = C("o_orderkey")
    return table(spark, sf, "orders").select(k.alias("minted"), (k * 7 % 40000).alias("canonical"), C("o_orderstatus").alias("kind"))


@query("L9_registry_laws", f"""WITH {REG} SELECT 'dangling' AS law, minted FROM reg WHERE canonical NOT IN (SELECT minted FROM reg) UNION ALL
  SELECT 'chained', a.minted FROM reg a JOIN reg b ON a.canonical = b.minted WHERE b.canonical <> b.minted UNION ALL SELECT 'kind', a.minted FROM reg a JOIN reg b ON a.canonical = b.minted WHERE a.kind <> b.kind""")
def l9(spark, sf):
    r = registry(spark, sf)
    j = r.join(r.select(C("minted").alias("canonical"), C("canonical").alias("next"), C("kind").alias("ck")), "canonical")
    a = missing(r, "canonical", r, "minted").select(F.lit("dangling").alias("law"), "minted")
    return a.union(j.filter("next <> canonical").select(F.lit("chained"), "minted")).union(j.filter("kind <> ck").select(F.lit("kind"), "minted"))


@query("L10_reconciliation", """WITH v AS (SELECT l_partkey a, l_suppkey b, count(*) n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1), waivers AS (SELECT s_suppkey x, s_nationkey y FROM supplier)
  SELECT a, b, n, CASE WHEN EXISTS (SELECT 1 FROM waivers WHERE (x = a AND y = b) OR (x = b AND y = a)) THEN 'warning' ELSE 'violation' END AS level_ FROM v""")
def l10(spark, sf):
    v = table(spark, sf, "lineitem").groupBy(C("l_partkey").alias("a"), C("l_suppkey").alias("b")).agg(F.count("*").alias("n")).filter("n > 1")
    w = table(spark, sf, "supplier").select(F.least("s_suppkey", "s_nationkey").alias("x"), F.greatest("s_suppkey", "s_nationkey").alias("y"), F.lit("warning").alias("level_")).distinct()
    j = v.withColumn("x", F.least("a", "b")).withColumn("y", F.greatest("a", "b")).join(w, ["x", "y"], "left")
    return j.select("a", "b", "n", F.coalesce("level_", F.lit("violation")).alias("level_"))


@query("L13_chronology_audit", "SELECT l_orderkey AS k, l_linenumber AS n, year(l_shipdate) AS ours, year(o_orderdate) AS theirs FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE year(l_shipdate) <> year(o_orderdate)")
def l13(spark, sf):
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), C("l_orderkey") == C("o_orderkey"))
    return j.select(C("l_orderkey").alias("k"), C("l_linenumber").alias("n"), F.year("l_shipdate").cast("long").alias("ours"), F.year("o_orderdate").cast("long").alias("theirs")).filter("ours <> theirs")


@query("L14_stale_pin", "SELECT count(*) AS rows_, sum(o_orderkey) AS root, 'stale' AS state FROM orders HAVING sum(o_orderkey) <> (SELECT sum(l_orderkey) FROM lineitem)")
def l14(spark, sf):
    built = table(spark, sf, "orders").agg(F.count("*").alias("rows_"), F.sum("o_orderkey").alias("root"))
    now = table(spark, sf, "lineitem").agg(F.sum("l_orderkey").alias("now"))
    return built.join(F.broadcast(now)).filter("root <> now").select("rows_", "root", F.lit("stale").alias("state"))  # one row each


@query("L16_era_overlap", """WITH h AS (SELECT l_suppkey e, l_orderkey f, l_orderkey + l_linenumber*2 u FROM lineitem), r AS (SELECT *, max(u) OVER (PARTITION BY e ORDER BY f, u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) reach FROM h)
  SELECT 'overlap' AS law, e, f, u FROM r WHERE reach > f""")
def l16(spark, sf):
    h = table(spark, sf, "lineitem").select(C("l_suppkey").alias("e"), C("l_orderkey").alias("f"), (C("l_orderkey") + C("l_linenumber") * 2).alias("u"))
    return incoherent(h, ["e"])


@query("J15_reference_resolution", "SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN o_orderkey IS NULL THEN 'event' WHEN s_suppkey IS NULL THEN 'place' END AS miss FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus <> 'P' LEFT JOIN supplier ON s_suppkey = l_suppkey WHERE o_orderkey IS NULL OR s_suppkey IS NULL")
def j15(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(C("o_orderkey").alias("l_orderkey"), F.lit(1).alias("event"))
    s = table(spark, sf, "supplier").select(C("s_suppkey").alias("l_suppkey"), F.lit(1).alias("place"))
    j = table(spark, sf, "lineitem").join(o, "l_orderkey", "left").join(s, "l_suppkey", "left")
    miss = F.when(C("event").isNull(), "event").when(C("place").isNull(), "place")
    return j.select(C("l_orderkey").alias("k"), C("l_linenumber").alias("n"), miss.alias("miss")).filter("miss IS NOT NULL")


def resolve_names(asked: DataFrame, known: DataFrame) -> DataFrame:
    """asked(q, name) and known(name, place, priority): canonical names (0) before aliases (1), then the least place."""
    base = lambda c: nm.base_name(c)
    j = asked.withColumn("base", base(C("name"))).join(known.select(base(C("name")).alias("base"), "place", "priority"), "base")
    return j.groupBy("q", "base").agg(F.min(F.struct("priority", "place")).alias("m")).select("q", "base", "m.place", "m.priority")


@query("J16_alias_resolution", """WITH known AS (SELECT lower(n_name) b, n_nationkey place, 0 priority FROM nation UNION ALL SELECT lower(n_name), (n_nationkey + 1) % 25, 1 FROM nation),
  asked AS (SELECT s_suppkey q, lower(n_name) b FROM supplier JOIN nation ON n_nationkey = s_nationkey)
  SELECT q, b AS base, arg_min(place, (priority, place)) AS place, min(priority) AS priority FROM asked JOIN known USING (b) GROUP BY 1, 2""")
def j16(spark, sf):
    n = table(spark, sf, "nation")
    known = n.select(C("n_name").alias("name"), C("n_nationkey").alias("place"), F.lit(0).alias("priority")).union(
        n.select(F.concat("n_name", F.lit(" (old)")), (C("n_nationkey") + 1) % 25, F.lit(1)))
    asked = table(spark, sf, "supplier").join(n, C("s_nationkey") == C("n_nationkey")).select(C("s_suppkey").alias("q"), F.concat("n_name", F.lit(" 2")).alias("name"))
    return resolve_names(asked, known)


@query("J17_identity_resolution", f"WITH {REG} SELECT l_orderkey AS k, l_linenumber AS n, coalesce(canonical, l_orderkey) AS canonical FROM lineitem LEFT JOIN reg ON minted = l_orderkey AND kind = 'F'")
def j17(spark, sf):
    r = registry(spark, sf).filter("kind = 'F'").select(C("minted").alias("l_orderkey"), "canonical")
    return table(spark, sf, "lineitem").join(r, "l_orderkey", "left").select(C("l_orderkey").alias("k"), C("l_linenumber").alias("n"), F.coalesce("canonical", "l_orderkey").alias("canonical"))


@query("J18_locus_binding", """WITH ranges AS (SELECT o_orderkey q, o_orderkey lo, o_orderkey + 3 hi FROM orders), att AS (SELECT l_suppkey ev, l_orderkey v FROM lineitem),
  c AS (SELECT q, ev, count(*) n FROM ranges JOIN att ON v BETWEEN lo AND hi GROUP BY 1, 2), r AS (SELECT *, dense_rank() OVER (PARTITION BY q ORDER BY n DESC) d FROM c) SELECT q, CASE WHEN count(*) = 1 THEN min(ev) END AS bound, max(n) AS verses FROM r WHERE d = 1 GROUP BY 1""")
def j18(spark, sf):
    ranges = table(spark, sf, "orders").select(C("o_orderkey").alias("q"), C("o_orderkey").alias("f"), (C("o_orderkey") + 4).alias("u"))
    verses = table(spark, sf, "lineitem").select(C("l_suppkey").alias("ev"), C("l_orderkey").alias("t"))
    n = iv.instants_within(verses, ranges, bucket=64).groupBy("q", "ev").agg(F.count("*").alias("n"))
    top = n.withColumn("d", F.dense_rank().over(Window.partitionBy("q").orderBy(C("n").desc()))).filter("d = 1")
    return top.groupBy("q").agg(F.when(F.count("*") == 1, F.min("ev")).alias("bound"), F.max("n").alias("verses"))


@query("J23_typed_names", """WITH c AS (SELECT l_partkey k, l_shipdate::DATE d, l_linestatus sense, count(*) n FROM lineitem GROUP BY 1, 2, 3), s AS (SELECT k, arg_max(sense, (n, sense)) sense FROM (SELECT k, sense, sum(n) n FROM c GROUP BY 1, 2) GROUP BY 1)
  SELECT p_partkey AS k, coalesce(sense, 'untyped') AS sense FROM part LEFT JOIN s ON k = p_partkey""")
def j23(spark, sf):
    n = table(spark, sf, "lineitem").groupBy(C("l_partkey").alias("k"), C("l_linestatus").alias("sense")).agg(F.count("*").alias("n"))
    s = n.groupBy("k").agg(F.max_by("sense", F.struct("n", "sense")).alias("sense"))
    return table(spark, sf, "part").select(C("p_partkey").alias("k")).join(s, "k", "left").select("k", F.coalesce("sense", F.lit("untyped")).alias("sense"))


@query("J24_priority_merge", "SELECT coalesce(s_suppkey, c_custkey) AS k, coalesce(s_nationkey, c_nationkey) AS nation FROM supplier FULL JOIN customer ON s_suppkey = c_custkey")
def j24(spark, sf):
    s = table(spark, sf, "supplier").select(C("s_suppkey").alias("k"), "s_nationkey")
    return s.join(table(spark, sf, "customer").select(C("c_custkey").alias("k"), "c_nationkey"), "k", "full").select("k", F.coalesce("s_nationkey", "c_nationkey").alias("nation"))


def kept_under_parents(claims: DataFrame, parents: DataFrame) -> DataFrame:
    """Claims (part, who) whose whole chain of parents (who, parent) also claims the part; roots need none. Rounds go on until none goes."""
    kept = materialize(claims, "claims")
    left, before = kept.count(), -1
    while left != before:
        up = kept.select("part", C("who").alias("parent"), F.lit(True).alias("ok"))
        kept = materialize(kept.join(parents, "who", "left").join(up, ["part", "parent"], "left").filter("parent IS NULL OR ok").select("part", "who"), "claims")
        before, left = left, kept.count()
    return kept


@query("J26_subdivision_rule", """WITH RECURSIVE claims AS (SELECT DISTINCT l_partkey part, l_suppkey % 16 who FROM lineitem), good AS (SELECT part, who FROM claims WHERE who = 0 UNION
  SELECT c.part, c.who FROM claims c JOIN good g ON g.part = c.part AND c.who // 2 = g.who AND c.who > 0) SELECT part, who FROM good""")
def j26(spark, sf):
    claims = table(spark, sf, "lineitem").select(C("l_partkey").alias("part"), (C("l_suppkey") % 16).alias("who")).distinct()
    parents = F.broadcast(spark.range(1, 16).select(C("id").alias("who"), F.floor(C("id") / 2).alias("parent")))  # the hierarchy: 15 rows
    return kept_under_parents(claims, parents)


@query("G9_parent_chain_depth", "SELECT c_custkey AS k, 1 + CASE WHEN n_nationkey IS NULL THEN 0 ELSE 1 END + CASE WHEN r_regionkey IS NULL THEN 0 ELSE 1 END AS depth FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def g9(spark, sf):
    node = lambda kind, key: F.concat(F.lit(kind), key)
    links = (table(spark, sf, "customer").select(node("c", C("c_custkey")).alias("n"), node("n", C("c_nationkey")).alias("up"))
             .union(table(spark, sf, "nation").select(node("n", C("n_nationkey")), node("r", C("n_regionkey")))))
    return chain_depth(links).filter("n LIKE 'c%'").select(F.substring("n", 2, 20).cast("long").alias("k"), "depth")


def chain_depth(links: DataFrame) -> DataFrame:
    """n, depth: nodes on the way up from each node, itself included; by doubling, so rounds are the logarithm of the longest way. Ways
    that never end are an error."""
    at = materialize(links.select("n", "up", C("up").isNotNull().cast("int").alias("steps")), "chains")
    left = at.filter("up IS NOT NULL").count()
    while left:
        ahead = at.select(C("n").alias("up"), C("up").alias("above"), C("steps").alias("more"))
        at = materialize(at.join(ahead, "up", "left").select("n", C("above").alias("up"), (C("steps") + F.coalesce("more", F.lit(0))).alias("steps")), "chains")
        before, left = left, at.filter("up IS NOT NULL").count()
        if left == before:
            raise ValueError(f"{left} nodes have no end above them")
    return at.select("n", (C("steps") + 1).alias("depth"))


@query("A24_affine_fit", """WITH q AS (SELECT p_partkey % 97 * 1.0 u, p_size * 1.0 v, 0.5*(p_partkey % 97) - 0.25*p_size + 3.0 + (p_partkey % 5)*0.001 t FROM part),
  s AS (SELECT count(*) n, sum(u) u, sum(v) v, sum(u*u) uu, sum(u*v) uv, sum(v*v) vv, sum(t) t, sum(u*t) ut, sum(v*t) vt FROM q), d AS (SELECT *, n*(uu*vv-uv*uv) - u*(u*vv-uv*v) + v*(u*uv-uu*v) det FROM s)
  SELECT round((t*(uu*vv-uv*uv) - u*(ut*vv-uv*vt) + v*(ut*uv-uu*vt))/det, 6) AS c, round((n*(ut*vv-uv*vt) - t*(u*vv-uv*v) + v*(u*vt-ut*v))/det, 6) AS a, round((n*(uu*vt-ut*uv) - u*(u*vt-ut*v) + t*(u*uv-uu*v))/det, 6) AS b FROM d""")
def a24(spark, sf):
    p = C("p_partkey")
    pts = table(spark, sf, "part").select((p % 97 * 1.0).alias("u"), (C("p_size") * 1.0).alias("v"), (0.5 * (p % 97) - 0.25 * C("p_size") + 3.0 + (p % 5) * 0.001).alias("t"))
    return affine_fit(pts).select(*[F.round(x, 6).alias(x) for x in "cab"])


def affine_fit(points: DataFrame) -> DataFrame:
    """Least squares t = c + a u + b v: one pass of sums, then Cramer's rule on one row."""
    s = points.agg(F.count("*").alias("n"), *[F.sum(e).alias(n) for n, e in (("u", C("u")), ("v", C("v")), ("uu", C("u") * C("u")), ("uv", C("u") * C("v")), ("vv", C("v") * C("v")), ("t", C("t")),
                                                                        ("ut", C("u") * C("t")), ("vt", C("v") * C("t")))])
    det3 = lambda m: sum((m[0][i] * (m[1][(i + 1) % 3] * m[2][(i + 2) % 3] - m[1][(i + 2) % 3] * m[2][(i + 1) % 3]) for i in (1, 2)),
                         m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]))
    left, right = [[C(x) for x in row] for row in (("n", "u", "v"), ("u", "uu", "uv"), ("v", "uv", "vv"))], [C("t"), C("ut"), C("vt")]
    put = lambda k: [[right[i] if j == k else left[i][j] for j in range(3)] for i in range(3)]
    return s.select(*[(det3(put(k)) / det3(left)).alias(n) for k, n in enumerate("cab")])


# laws whose violations the report unites: what each query tells is a breach
REPORTED = ["L1_anchor", "L2_history_coherence", "L3_provenance", "L5_authority_order", "L6_event_references", "L7_store_closure", "L8_frame_edge", "L9_registry_laws",
            "L13_chronology_audit", "L16_era_overlap"]


def breaches(spark, sf, names: list[str]) -> DataFrame:
    """law, breach (the violating row as JSON) of every named law query, in one table."""
    out = None
    for name in names:
        rows = QUERIES[name](spark, sf)
        one = rows.select(F.lit(name.partition("_")[0]).alias("law"), F.to_json(F.struct(*[F.col(c) for c in rows.columns])).alias("breach"))
        out = one if out is None else out.unionByName(one)
    return out


_LEVELS = "SELECT 'L10' AS law, CASE WHEN level_ = 'warning' THEN 'warning' ELSE 'violation' END AS level_, count(*) AS n FROM ({}) GROUP BY 2"


@query("S19_law_report", " UNION ALL ".join([f"SELECT * FROM (SELECT '{n.partition('_')[0]}' AS law, 'violation' AS level_, count(*) AS n FROM ({ORACLE_SQL[n]}) HAVING count(*) > 0)" for n in REPORTED]
                                            + [_LEVELS.format(ORACLE_SQL["L10_reconciliation"])]))
def s19_report(spark, sf):
    """How often each law is broken, over the union of all law queries; what reconciliation waives is a warning."""
    every = breaches(spark, sf, REPORTED).select("law", F.lit("violation").alias("level_"))
    pairs = QUERIES["L10_reconciliation"](spark, sf).select(F.lit("L10").alias("law"), "level_")
    return every.unionByName(pairs).groupBy("law", "level_").agg(F.count("*").alias("n"))
