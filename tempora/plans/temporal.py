"""Queries on the interval store: state lookups, censuses, diffs, events, eras, sweeps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tempora.functions.sets import set_text
from tempora.operators import intervals as iv
from tempora.operators.order import numbered
from tempora.plans import fixtures as fx
from tempora.plans.catalog import query
from tempora.plans.fixtures import T1, T2, with_
from tempora.sources.tables import table

AT = lambda t: f"f <= {t} AND (u IS NULL OR {t} < u)"


@query("W1_islands", with_("standings") + "SELECT layer, e, f, u FROM standings")
def w1(spark, sf):
    return fx.standings(spark, sf).select("layer", "e", "f", "u")


@query("W2_versions_on_change", with_("versions") + "SELECT e, st, f, u FROM versions")
def w2(spark, sf):
    return fx.versions(spark, sf).select("e", "st", "f", "u")


@query("W5_interval_end_from_next_start", with_("stated") + "SELECT e, t AS f, lead(t) OVER (PARTITION BY e ORDER BY t) AS u FROM stated")
def w5(spark, sf):
    return fx.stated(spark, sf).select("e", F.col("t").alias("f"), F.lead("t").over(Window.partitionBy("e").orderBy("t")).alias("u"))


@query("J1_state_at_instant", with_("standings") + f"SELECT layer, e, f, u FROM standings WHERE {AT(T1)}")
def j1(spark, sf):
    return iv.valid_at(fx.standings(spark, sf), T1).select("layer", "e", "f", "u")


@query("J1_as_of_batch", """SELECT p.event_id, p.user_id, s.event_type AS state FROM (SELECT * FROM events WHERE event_type = 'click') p
  ASOF JOIN (SELECT * FROM events WHERE event_type <> 'click') s ON p.user_id = s.user_id AND p.ts >= s.ts""")
def j1b(spark, sf):
    ev = table(spark, sf, "events")
    probes = ev.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    states = ev.filter("event_type <> 'click'").select("user_id", "ts", F.col("event_type").alias("state"))
    return iv.as_of(probes, states, ["user_id"], "ts", ["state"]).filter("state IS NOT NULL").select("event_id", "user_id", "state")


@query("J2_versions_holding_instants", with_("versions") + """SELECT q.t, v.e, v.st FROM (SELECT DISTINCT month(o_orderdate) + year(o_orderdate)*12 t FROM orders) q
  JOIN versions v ON v.f <= q.t AND (v.u IS NULL OR q.t < v.u)""")
def j2(spark, sf):
    asked = table(spark, sf, "orders").select(fx.month("o_orderdate").alias("t")).distinct()
    return iv.instants_within(asked, fx.versions(spark, sf)).select("t", "e", "st")


@query("J3_interval_overlap", with_("standings", "versions") + """SELECT s.e, s.f, s.u, v.st, v.f AS vf FROM standings s JOIN versions v ON s.e = v.e
  AND s.f < coalesce(v.u, 999999) AND v.f < s.u""")
def j3(spark, sf):
    v = fx.versions(spark, sf).select("e", "st", F.col("f").alias("vf"), F.col("u").alias("vu"))
    return fx.standings(spark, sf).join(v, "e").filter(iv.overlaps("f", "u", "vf", "vu")).select("e", "f", "u", "st", "vf")


@query("J4_shadow_anti_join", with_("months", "standings") + """SELECT m.e, m.t + 2 AS t FROM months m WHERE NOT EXISTS
  (SELECT 1 FROM standings s WHERE s.e = m.e AND s.f <= m.t + 2 AND m.t + 2 <= s.u)""")
def j4(spark, sf):
    background = fx.months(spark, sf).select("e", (F.col("t") + 2).alias("t"))
    return iv.shadowed(background, fx.standings(spark, sf).select("e", "f", "u"), ["e"], "t")


@query("A1_census", with_("standings") + f"SELECT e, name, layer, 'area' AS kind, 'held' AS tenure FROM standings WHERE {AT(T1)} ORDER BY layer, e")
def a1(spark, sf):
    rows = iv.valid_at(fx.standings(spark, sf), T1)
    return rows.select("e", "name", "layer", F.lit("area").alias("kind"), F.lit("held").alias("tenure")).orderBy("layer", "e")


@query("T2_census_diff", with_("bodies") + f"""SELECT CASE WHEN a.e IS NULL THEN 'Added' WHEN b.e IS NULL THEN 'Removed' ELSE 'Changed' END AS tag, coalesce(a.e, b.e) AS e,
  a.st AS was, b.st AS now FROM (SELECT * FROM bodies WHERE {AT(T1)}) a FULL JOIN (SELECT * FROM bodies WHERE {AT(T2)}) b ON a.e = b.e WHERE a.st IS DISTINCT FROM b.st""")
def t2(spark, sf):
    b = fx.bodies(spark, sf)
    return iv.census_diff(iv.valid_at(b, T1), iv.valid_at(b, T2), ["e"], "st")


EVENTS = """, nb AS (SELECT *, lag(u) OVER w lu, lead(f) OVER w nf FROM bodies WINDOW w AS (PARTITION BY e ORDER BY f)),
  ev AS (SELECT e, 'Rise' kind, f t FROM nb WHERE lu IS DISTINCT FROM f UNION ALL SELECT e, 'Shift', f FROM nb WHERE lu = f
  UNION ALL SELECT e, 'Fall', u FROM nb WHERE nf IS DISTINCT FROM u) """


@query("W3_derive_events", with_("bodies") + EVENTS + "SELECT e, kind, t FROM ev")
def w3(spark, sf):
    return iv.derive_events(fx.bodies(spark, sf), ["e"], "st")


@query("T5_changes_between", with_("bodies") + EVENTS + f"SELECT e, kind, t FROM ev WHERE t > {T1} AND t <= {T2}")
def t5(spark, sf):
    lo, hi = sorted((T2, T1))
    return iv.derive_events(fx.bodies(spark, sf), ["e"], "st").filter((F.col("t") > lo) & (F.col("t") <= hi))


@query("W4_epoch_diff_narration", with_("stated") + """SELECT coalesce(a.t + 1, b.t) AS t, coalesce(a.st, b.st) AS st, coalesce(a.n, 0) AS left_, coalesce(b.n, 0) AS joined FROM
  (SELECT t, st, count(*) n FROM (SELECT x.e, x.t, x.st FROM stated x WHERE NOT EXISTS (SELECT 1 FROM stated y WHERE y.e = x.e AND y.st = x.st AND y.t = x.t + 1)) GROUP BY 1, 2) a
  FULL JOIN (SELECT t, st, count(*) n FROM (SELECT x.e, x.t, x.st FROM stated x WHERE NOT EXISTS (SELECT 1 FROM stated y WHERE y.e = x.e AND y.st = x.st AND y.t = x.t - 1)) GROUP BY 1, 2) b
  ON a.t + 1 = b.t AND a.st = b.st""")
def w4(spark, sf):
    s = fx.stated(spark, sf)
    gone = s.join(s.select("e", "st", (F.col("t") - 1).alias("t")), ["e", "st", "t"], "left_anti").groupBy((F.col("t") + 1).alias("t"), "st").agg(F.count("*").alias("left_"))
    came = s.join(s.select("e", "st", (F.col("t") + 1).alias("t")), ["e", "st", "t"], "left_anti").groupBy("t", "st").agg(F.count("*").alias("joined"))
    return gone.join(came, ["t", "st"], "full").select("t", "st", F.coalesce("left_", F.lit(0)).alias("left_"), F.coalesce("joined", F.lit(0)).alias("joined"))


@query("T10_symmetric_difference", with_("stated") + f"""(SELECT e, st, 'before' AS side FROM stated WHERE t = {T1} EXCEPT SELECT e, st, 'before' FROM stated WHERE t = {T2})
  UNION ALL (SELECT e, st, 'after' FROM stated WHERE t = {T2} EXCEPT SELECT e, st, 'after' FROM stated WHERE t = {T1})""")
def t10(spark, sf):
    s = fx.stated(spark, sf)
    a, b = (s.filter(F.col("t") == t).select("e", "st") for t in (T1, T2))
    return a.exceptAll(b).withColumn("side", F.lit("before")).unionByName(b.exceptAll(a).withColumn("side", F.lit("after")))


@query("T4_moment_sweep", with_("standings") + """, ms AS (SELECT layer, f t FROM standings UNION SELECT layer, u FROM standings)
  SELECT m.layer, m.t, count(s.e) AS n, sha256(coalesce(string_agg(s.e::VARCHAR, ',' ORDER BY s.e::VARCHAR), '')) AS snapshot
  FROM ms m LEFT JOIN standings s ON s.layer = m.layer AND s.f <= m.t AND m.t < s.u GROUP BY 1, 2""")
def t4(spark, sf):
    st = fx.standings(spark, sf)
    ms = iv.moments(st, ["layer"])
    held = iv.instants_within(ms.withColumnRenamed("layer", "ml"), st).filter("ml = layer").select("layer", "t", "e")
    n = ms.join(held, ["layer", "t"], "left").groupBy("layer", "t")
    return n.agg(F.count("e").alias("n"), F.sha2(set_text("e"), 256).alias("snapshot"))


@query("T9_one_snapshot_an_instant", """SELECT o_custkey AS e, year(o_orderdate)*12+month(o_orderdate) AS f, count(DISTINCT o_orderstatus) AS n FROM orders
  GROUP BY 1, 2 HAVING count(DISTINCT o_orderstatus) > 1""")
def t9(spark, sf):
    """Instants of an entity for which its witnesses tell more than one state: such a history is refused."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("e"), fx.month("o_orderdate").alias("f"), "o_orderstatus")
    return o.groupBy("e", "f").agg(F.countDistinct("o_orderstatus").alias("n")).filter("n > 1")


@query("T3_merge_refusing_duplicates", "SELECT k, count(*) AS n FROM (SELECT c_custkey k FROM customer UNION ALL SELECT s_suppkey FROM supplier) GROUP BY 1 HAVING count(*) > 1")
def t3(spark, sf):
    both = table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).union(table(spark, sf, "supplier").select("s_suppkey"))
    return both.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1")


@query("T6_accumulation", with_("standings") + f""", seen AS (SELECT layer, e, f, u, row_number() OVER (PARTITION BY layer, e ORDER BY f) rn, f <= {T2} AND {T2} < u AS current FROM standings WHERE f <= {T2})
  SELECT layer, e, f, 'full' AS part, CAST(1.0 AS DOUBLE) AS age FROM seen WHERE current
  UNION ALL SELECT layer, e, f, 'outline', round((f - {T1}) / {float(T2 - T1)}, 6) FROM seen s WHERE rn = 1 AND f >= {T1} AND NOT current""")
def t6(spark, sf):
    st = fx.standings(spark, sf).filter(F.col("f") <= T2)
    first = F.row_number().over(Window.partitionBy("layer", "e").orderBy("f"))
    seen = st.withColumn("rn", first).withColumn("current", iv.contains(T2))
    full = seen.filter("current").select("layer", "e", "f", F.lit("full").alias("part"), F.lit(1.0).alias("age"))
    older = seen.filter(f"rn = 1 AND f >= {T1} AND NOT current").select("layer", "e", "f", F.lit("outline").alias("part"), F.round((F.col("f") - T1) / float(T2 - T1), 6).alias("age"))
    return full.unionByName(older)


@query("T7_two_scenes_compared", with_("standings") + f"SELECT layer, e, 'held' AS side FROM standings WHERE {AT(T1)} UNION ALL SELECT layer, e, 'current' FROM standings WHERE {AT(T2)}")
def t7(spark, sf):
    st = fx.standings(spark, sf)
    side = lambda t, s: iv.valid_at(st, t).select("layer", "e", F.lit(s).alias("side"))
    return side(T1, "held").unionByName(side(T2, "current"))


# events in groups of twelve keys, those that make a split or a merge replaced by it; others: the children or parents
TURNS = EVENTS + """, gr AS (SELECT *, e // 12 g FROM ev),
  both_ AS (SELECT g, t, list(e ORDER BY e) FILTER (kind = 'Fall') falls, list(e ORDER BY e) FILTER (kind = 'Rise') rises FROM gr GROUP BY 1, 2),
  turn AS (SELECT g, t, 'Split' kind, falls[1] e, array_to_string(rises, ',') others FROM both_ WHERE len(falls) = 1 AND len(rises) > 1
    UNION ALL SELECT g, t, 'Merge', rises[1], array_to_string(falls, ',') FROM both_ WHERE len(rises) = 1 AND len(falls) > 1),
  turned AS (SELECT kind, e, t, others FROM turn UNION ALL SELECT kind, e, t, NULL FROM gr WHERE kind = 'Shift' OR NOT EXISTS (SELECT 1 FROM turn x WHERE x.g = gr.g AND x.t = gr.t)),
  plan AS (SELECT CASE kind WHEN 'Rise' THEN 'FadeIn' WHEN 'Fall' THEN 'FadeOut' WHEN 'Shift' THEN 'Morph' ELSE kind END AS verb, e, others, t, kind FROM turned) """


@query("T8_transition_plan", with_("bodies") + TURNS + f"SELECT verb, e, others, t, row_number() OVER (ORDER BY t, e, kind) AS seq FROM plan WHERE t > {T1} AND t <= {T1 + 3}")
def t8(spark, sf):
    return transition_plan(turns(spark, sf), T1, T1 + 3)


def turns(spark, sf):
    """Events with splits and merges within groups of twelve keys."""
    return splits_and_merges(iv.derive_events(fx.bodies(spark, sf), ["e"], "st").withColumn("g", F.floor(F.col("e") / 12)), "g")


def splits_and_merges(events, group: str):
    """Events (kind, e, t, others): where one key of a group falls at the instant at which several rise, it splits into them; where
    several fall as one rises, they merge into it. ``others`` has the children or parents in order, comma-separated."""
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("e"))))
    both = events.filter("kind <> 'Shift'").groupBy(group, "t").agg(of("Fall").alias("falls"), of("Rise").alias("rises"))
    split, merge = (F.size("falls") == 1) & (F.size("rises") > 1), (F.size("rises") == 1) & (F.size("falls") > 1)
    turn = both.filter(split | merge).select(group, "t", F.when(split, "Split").otherwise("Merge").alias("kind"), F.get(F.when(split, F.col("falls")).otherwise(F.col("rises")), F.lit(0)).alias("e"),
                                             F.array_join(F.when(split, F.col("rises")).otherwise(F.col("falls")), ",").alias("others"))
    plain = events.filter("kind <> 'Shift'").join(turn.select(group, "t"), [group, "t"], "left_anti").unionByName(events.filter("kind = 'Shift'"))
    return turn.drop(group).unionByName(plain.select("kind", "e", "t", F.lit(None).cast("string").alias("others")))


BACK = {"FadeIn": "FadeOut", "FadeOut": "FadeIn", "Split": "Merge", "Merge": "Split"}


def transition_plan(events, lo: int, hi: int):
    """Ordered steps from instant lo to hi; a plan that runs backwards has the reverse order and the opposite verbs."""
    back = lo > hi
    span = events.filter((F.col("t") > min(lo, hi)) & (F.col("t") <= max(lo, hi)))
    keys = [F.col(c).desc() if back else F.col(c) for c in ("t", "e", "kind")]
    verb = verbs(F.col("kind"))
    if back:
        verb = F.coalesce(*[F.when(verb == a, b) for a, b in BACK.items()], verb)
    return numbered(span, keys, "seq").select(verb.alias("verb"), "e", "others", "t", "seq")


def verbs(kind):
    return F.when(kind == "Rise", "FadeIn").when(kind == "Fall", "FadeOut").when(kind == "Shift", "Morph").otherwise(kind)


@query("W6_date_fill", with_("steps") + """, d AS (SELECT e, seq, CASE WHEN event_type = 'purchase' THEN event_id END v FROM steps)
  SELECT e, seq, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY e ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(v IGNORE NULLS) OVER (PARTITION BY e ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM d""")
def w6(spark, sf):
    d = fx.steps(spark, sf).select("e", "seq", F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("v"))
    w = Window.partitionBy("e").orderBy("seq")
    back = F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("v", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return d.select("e", "seq", F.coalesce(back, ahead).alias("v"))


LEGS = """, legs AS (SELECT e, seq, event_id a, lead(event_id) OVER w b, ts depart, lead(ts) OVER w arrive, count(*) OVER (PARTITION BY e) n FROM steps WINDOW w AS (PARTITION BY e ORDER BY seq)) """


@query("W7_legs", with_("steps") + LEGS + "SELECT e, seq, a, b, least(a, b) AS first_, greatest(a, b) AS second_ FROM legs WHERE b IS NOT NULL AND n > 1")
def w7(spark, sf):
    w = Window.partitionBy("e").orderBy("seq")
    legs = fx.steps(spark, sf).select("e", "seq", F.col("event_id").alias("a"), F.lead("event_id").over(w).alias("b"), F.count("*").over(Window.partitionBy("e")).alias("n"))
    return legs.filter("b IS NOT NULL AND n > 1").select("e", "seq", "a", "b", F.least("a", "b").alias("first_"), F.greatest("a", "b").alias("second_"))


@query("W8_presence_check", """SELECT * FROM (SELECT l_suppkey AS who, l_orderkey AS f, l_orderkey + l_linenumber AS u,
  max(l_orderkey + l_linenumber) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM lineitem) WHERE u <= f OR reach > f""")
def w8(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("who"), F.col("l_orderkey").alias("f"), (F.col("l_orderkey") + F.col("l_linenumber")).alias("u"), "l_linenumber")
    reach = F.max("u").over(Window.partitionBy("who").orderBy("f", "l_linenumber").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("reach", reach).filter("u <= f OR reach > f").select("who", "f", "u", "reach")


ERAS = """, cuts AS (SELECT f t FROM presence UNION SELECT u FROM presence), wins AS (SELECT t f, lead(t) OVER (ORDER BY t) u FROM cuts) """


@query("W9_eras_absent", with_("presence") + ERAS + """SELECT w.f, w.u, count(p.who) AS standing, (SELECT count(*) FROM presence) - count(p.who) AS absent FROM wins w
  LEFT JOIN presence p ON p.f <= w.f AND w.u <= p.u WHERE w.u IS NOT NULL GROUP BY 1, 2""")
def w9(spark, sf):
    return iv.eras(fx.presence(spark, sf)).select("f", "u", "standing", "absent")


@query("W9_absent_spans", with_("presence") + """, ends AS (SELECT min(f) lo, max(u) hi FROM presence)
  SELECT who, lo AS f, p.f AS u FROM presence p, ends WHERE p.f > lo UNION ALL SELECT who, p.u, hi FROM presence p, ends WHERE p.u < hi""")
def w9_spans(spark, sf):
    """The absent sets of all eras as spans: who is absent in an era is whose span covers it."""
    return iv.absent_spans(fx.presence(spark, sf)).select("who", "f", "u")


@query("W22_sample_times", with_("bodies") + EVENTS + f"SELECT {T1} AS t UNION SELECT {T2} UNION SELECT t FROM ev WHERE t >= {T1} AND t <= {T2}")
def w22(spark, sf):
    ends = spark.createDataFrame([(T1,), (T2,)], "t long")
    return ends.union(iv.derive_events(fx.bodies(spark, sf), ["e"], "st").select("t").filter(F.col("t").between(T1, T2))).distinct()


@query("A22_stop_list", with_("bodies") + EVENTS + "SELECT t // 12 AS stop FROM ev UNION SELECT min(t // 12) - 100 FROM ev")
def a22(spark, sf):
    years = iv.derive_events(fx.bodies(spark, sf), ["e"], "st").select(F.floor(F.col("t") / 12).alias("stop")).distinct()
    return years.union(years.select(F.min("stop") - 100)).distinct()


@query("A17_subject_presence", with_("versions") + """SELECT v.e, string_agg(q.t::VARCHAR, ',' ORDER BY q.t::VARCHAR) AS stops, arg_max(v.st, q.t) AS label
  FROM (SELECT DISTINCT (t // 12) * 12 t FROM stated) q JOIN versions v ON v.f <= q.t AND (v.u IS NULL OR q.t < v.u) GROUP BY 1""")
def a17(spark, sf):
    stops = fx.stated(spark, sf).select((F.floor(F.col("t") / 12) * 12).alias("t")).distinct()
    held = iv.instants_within(stops, fx.versions(spark, sf))
    return held.groupBy("e").agg(set_text("t").alias("stops"), F.max_by("st", "t").alias("label"))


@query("P11_interval_predicates", with_("versions") + f"SELECT e, f, u, f <= {T1} AND (u IS NULL OR {T1} < u) AS holds, f < {T2} AND (u IS NULL OR {T1} < u) AS meets FROM versions")
def p11(spark, sf):
    v = fx.versions(spark, sf)
    return v.select("e", "f", "u", iv.contains(T1).alias("holds"), iv.overlaps("f", "u", F.lit(T1), F.lit(T2)).alias("meets"))


@query("K1_total_order", with_("bodies") + f"SELECT e, st, row_number() OVER (ORDER BY st, e, f) AS place FROM bodies WHERE {AT(T1)}")
def k1(spark, sf):
    return numbered(iv.valid_at(fx.bodies(spark, sf), T1), [F.col(c) for c in ("st", "e", "f")], "place").select("e", "st", "place")


@query("J25_before_and_after", with_("bodies") + "SELECT e, f AS t, st AS after_, lag(st) OVER w AS before_ FROM bodies WINDOW w AS (PARTITION BY e ORDER BY f) QUALIFY lag(u) OVER w = f")
def j25(spark, sf):
    w = Window.partitionBy("e").orderBy("f")
    rows = fx.bodies(spark, sf).select("e", F.col("f").alias("t"), F.col("st").alias("after_"), F.lag("st").over(w).alias("before_"), F.lag("u").over(w).alias("lu"))
    return rows.filter("lu = t").drop("lu")


@query("W28_bound_date_repair", with_("steps").replace("WITH", "WITH RECURSIVE", 1) + """, p AS (SELECT e, seq, event_id own, CASE WHEN event_id % 4 <> 0 THEN event_id + event_id * 37 % 401 - 200 END bound FROM steps),
  r AS (SELECT e, seq, coalesce(bound, own) d, bound IS NOT NULL driven FROM p WHERE seq = 1
    UNION ALL SELECT p.e, p.seq, CASE WHEN p.bound > r.d THEN p.bound ELSE p.own END, coalesce(p.bound > r.d, false) FROM r JOIN p ON p.e = r.e AND p.seq = r.seq + 1),
  ends AS (SELECT e, max(seq) seq, arg_max(d, seq) d, arg_max(own, seq) own FROM (SELECT r.e, r.seq, d, own FROM r JOIN p ON p.e = r.e AND p.seq = r.seq) GROUP BY e),
  fall AS (SELECT e, seq + 1 seq, own + 100 own, CASE WHEN e % 2 = 0 THEN own + e % 300 - 150 END bound, d FROM ends)
  SELECT e, seq, d AS date_, driven, 'phase' AS part FROM r UNION ALL SELECT e, seq, CASE WHEN bound > d THEN bound ELSE own END, coalesce(bound > d, false), 'fall' FROM fall""")
def w28(spark, sf):
    """Eras whose phases (a user's events) and falls have a date of their own and, some of them, one bound to an authority's event."""
    i = F.col("event_id")
    phases = fx.steps(spark, sf).select("e", "seq", i.alias("own"), F.when(i % 4 != 0, i + i * 37 % 401 - 200).alias("bound"))
    ends = phases.groupBy("e").agg((F.max("seq") + 1).alias("seq"), F.max_by("own", "seq").alias("last"))
    falls = ends.select("e", "seq", (F.col("last") + 100).alias("own"), F.when(F.col("e") % 2 == 0, F.col("last") + F.col("e") % 300 - 150).alias("bound"))
    rows = phases.withColumn("part", F.lit("phase")).unionByName(falls.withColumn("part", F.lit("fall")))
    return iv.repaired(rows, "e", "seq", "own", "bound").select("e", "seq", "date_", "driven", "part")


@query("W29_route_construction", with_("steps") + """SELECT e, seq, event_id, 'way' AS part FROM steps UNION ALL
  SELECT e, (SELECT max(seq) FROM steps x WHERE x.e = s.e) + 1, event_id, 'close' FROM steps s WHERE seq = 1 UNION ALL
  SELECT e, seq, event_id, CASE seq WHEN 1 THEN 'Rise' ELSE 'Journey' END FROM steps""")
def w29(spark, sf):
    s = fx.steps(spark, sf).withColumn("last", F.max("seq").over(Window.partitionBy("e")))
    parts = F.array(F.struct(F.col("seq").alias("seq"), F.lit("way").alias("part")),
                    F.when(F.col("seq") == 1, F.struct((F.col("last") + 1).alias("seq"), F.lit("close").alias("part"))),
                    F.struct(F.col("seq").alias("seq"), F.when(F.col("seq") == 1, "Rise").otherwise("Journey").alias("part")))
    return s.select("e", "event_id", F.explode(F.filter(parts, lambda x: x.isNotNull())).alias("x")).select("e", "x.seq", "event_id", "x.part")
