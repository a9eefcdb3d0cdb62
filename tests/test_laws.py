"""Properties that hold on any input, and seeded bad rows that the laws must find."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tempora.functions import geo as g
from tempora.functions import timeaxis as ta
from tempora.operators import intervals as iv
from tempora.operators import overlay as ov
from tempora.operators import rings as rg
from tempora.operators import spatial as sp
from tempora.operators.graph import connected_components
from tempora.plans import fixtures as fx
from tempora.plans.laws import chain_depth, incoherent, kept_under_parents, missing
from tempora.plans.networks import coloured, thinned
from tempora.plans.temporal import splits_and_merges, transition_plan, turns
from tempora.sources import geojson, raster, store


def test_diff_of_an_instant_with_itself_is_empty(spark, sf_dir):
    at = iv.valid_at(fx.bodies(spark, sf_dir), fx.T1)
    assert iv.census_diff(at, at, ["e"], "st").isEmpty()


def test_moments_are_the_union_of_edges(spark, sf_dir):
    st = fx.standings(spark, sf_dir)
    n = st.select("layer", F.explode(F.array("f", "u")).alias("t")).distinct()
    assert iv.moments(st, ["layer"]).exceptAll(n).isEmpty()


def test_plan_backwards_is_the_reverse(spark, sf_dir):
    ev = turns(spark, sf_dir)
    there = [(r.verb, r.e, r.t) for r in transition_plan(ev, fx.T1, fx.T2).orderBy("seq").collect()]
    back = [(r.verb, r.e, r.t) for r in transition_plan(ev, fx.T2, fx.T1).orderBy("seq").collect()]
    turned = {"FadeIn": "FadeOut", "FadeOut": "FadeIn", "Morph": "Morph", "Split": "Merge", "Merge": "Split"}
    assert {v for v, _, _ in there} == set(turned)
    assert there and back == [(turned[v], e, t) for v, e, t in reversed(there)]
    assert transition_plan(ev, fx.T1, fx.T1).isEmpty()


def test_splits_and_merges_take_their_events(spark):
    rows = [("Fall", 1, 5), ("Rise", 2, 5), ("Rise", 3, 5), ("Fall", 2, 9), ("Fall", 3, 9), ("Rise", 4, 9), ("Shift", 5, 9), ("Fall", 4, 12), ("Rise", 6, 12)]
    ev = spark.createDataFrame([(*r, 0) for r in rows], "kind string, e long, t long, g long")
    got = {(r.kind, r.e, r.t, r.others) for r in splits_and_merges(ev, "g").collect()}
    assert got == {("Split", 1, 5, "2,3"), ("Merge", 4, 9, "2,3"), ("Shift", 5, 9, None), ("Fall", 4, 12, None), ("Rise", 6, 12, None)}


def test_resampling_goes_in_equal_steps(spark):
    at = lambda k, lons: [(k, i, 0.0, float(x)) for i, x in enumerate(lons)]
    rows = at(1, [0, 10, 40]) + at(2, [5, 5, 5]) + at(3, [7])
    line = spark.createDataFrame(rows, "id long, seq long, lat double, lon double").select("id", "seq", g.vec(F.col("lat"), F.col("lon")).alias("v"))
    n = spark.createDataFrame([(1, 5), (2, 3), (3, 2)], "id long, n long")
    got = [(r.id, r.i, round(r.lon, 6)) for r in rg.resampled(line, "id", n).select("id", "i", g.lon_of(F.col("v")).alias("lon")).orderBy("id", "i").collect()]
    assert got == [(1, 0, 0), (1, 1, 10), (1, 2, 20), (1, 3, 30), (1, 4, 40), (2, 0, 5), (2, 1, 5), (2, 2, 5), (3, 0, 7)]


def test_open_intervals_hold_later_instants(spark):
    t = spark.createDataFrame([(1, 5, None), (2, 5, 9)], "e long, f long, u long")
    asked = spark.createDataFrame([(4,), (5,), (9,), (500,)], "t long")
    got = {(r.t, r.e) for r in iv.instants_within(asked, t).collect()}
    assert got == {(5, 1), (9, 1), (500, 1), (5, 2)}


def test_bad_histories_and_references_are_found(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 4, 6), ("b", 3, 3), ("c", 1, 2), ("c", 2, 3)], "e string, f long, u long")
    assert {(r.law, r.e) for r in incoherent(rows, ["e"]).collect()} == {("overlap", "a"), ("empty", "b")}
    known = spark.createDataFrame([(1,)], "id long")
    assert [r.f for r in missing(rows.filter("e = 'a'"), "f", known, "id").collect()] == [4]


def test_bound_dates_are_repaired_in_order(spark):
    """Against the plain fold: runs of repairs, equal dates, rows without a bound date, long keys."""
    rng = random.Random(6)
    rows = [(e, k, 10 * k + rng.randint(-15, 15), rng.choice([None, 10 * k + rng.randint(-40, 40)])) for e in range(40) for k in range(rng.choice([1, 2, 7, 60]))]
    want, before = {}, {}
    for e, k, own, bound in rows:
        keeps = bound is not None and (e not in before or bound > before[e])
        before[e] = bound if keeps else own
        want[e, k] = (before[e], keeps)
    df = spark.createDataFrame(rows, "e long, k long, own long, bound long").repartition(5)
    got = {(r.e, r.k): (r.date_, r.driven) for r in iv.repaired(df, "e", "k", "own", "bound").collect()}
    assert got == want and sum(b is not None and not want[e, k][1] for e, k, _, b in rows) > 50


def test_chains_of_any_length(spark):
    long = [(f"n{k}", f"n{k + 1}") for k in range(90)] + [("x", None), ("y", "n89")]
    depth = {r.n: r.depth for r in chain_depth(spark.createDataFrame(long, "n string, up string")).collect()}
    assert depth["n0"] == 91 and depth["n89"] == 2 and depth["x"] == 1 and depth["y"] == 3
    with pytest.raises(ValueError, match="no end"):
        chain_depth(spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d")], "n string, up string"))
    claims = spark.createDataFrame([(1, k) for k in range(30)] + [(2, k) for k in range(30) if k != 3], "part long, who long")
    parents = spark.range(1, 30).select(F.col("id").alias("who"), (F.col("id") - 1).alias("parent"))
    assert sorted((r.part, r.who) for r in kept_under_parents(claims, parents).collect()) == [*((1, k) for k in range(30)), (2, 0), (2, 1), (2, 2)]


def test_years_have_no_zero(spark):
    rows = spark.createDataFrame([("-1450-01-14",), ("-1",), ("0",), ("12-13",), ("x",), ("7-02",)], "s string")
    assert [r[0] for r in rows.select(ta.parsed_key(F.col("s"))).collect()] == [-14499886, -10000, None, None, None, 70200]
    r = spark.range(1).select(ta.year_after(F.lit(-1)), ta.years_between(F.lit(-1), F.lit(1)), ta.epoch_of(F.lit("world_bc2000.geojson"))).first()
    assert tuple(r) == (1, 1, -2000)


def test_distance_to_arc_and_slerp(spark):
    v = lambda lat, lon: g.vec(F.lit(lat), F.lit(lon))
    r = spark.range(1).select(g.to_arc(v(10.0, 5.0), v(0.0, 0.0), v(0.0, 20.0)), g.to_arc(v(0.0, 30.0), v(0.0, 0.0), v(0.0, 20.0)),
                              g.slerp(v(0.0, 0.0), v(0.0, 180.0), F.lit(0.5)), g.lon_of(g.slerp(v(0.0, 0.0), v(0.0, 90.0), F.lit(0.5)))).first()
    assert r[0] == pytest.approx(math.radians(10)) and r[1] == pytest.approx(math.radians(10)) and r[2] is None and r[3] == pytest.approx(45)


def squares(spark, *boxes):
    rows = [(k, i, y, x) for k, y0, x0, y1, x1 in boxes for i, (y, x) in enumerate([(y0, x0), (y0, x1), (y1, x1), (y1, x0)])]
    return spark.createDataFrame(rows, "rid long, seq long, qlat long, qlon long")


def overlay(spark, rings, size=500.0):
    s = sp.ring_edges(rings).select(F.col("rid").alias("wid"), F.col("seq").alias("sid"), "ay", "ax", "by_", "bx")
    edges = ov.split_at_nodes(s, size)
    traced = ov.cycles(ov.half_edges(edges))
    faces = ov.face_table(traced)
    return edges, traced, faces, ov.claims(faces, rings)


def test_overlay_of_two_squares(spark):
    _, traced, faces, claims = overlay(spark, squares(spark, (1, 0, 0, 1000, 1000), (2, 500, 500, 1500, 1500)))
    area = sorted(r.area for r in faces.collect())
    assert area == [-1750000, 250000, 750000, 750000]
    assert sorted(r.n for r in claims.groupBy("face").agg(F.count("*").alias("n")).collect()) == [1, 1, 2]
    owner = claims.groupBy("face").agg(F.min("rid").alias("rid"))
    merged = ov.dissolved(owner, traced).groupBy("rid").agg(F.count("*").alias("n"))
    assert {r.rid: r.n for r in merged.collect()} == {1: 6, 2: 6}


def test_shared_edges_are_one_and_touching_is_no_overlap(spark):
    edges, _, faces, claims = overlay(spark, squares(spark, (1, 0, 0, 1000, 1000), (2, 0, 1000, 1000, 2000), (3, 1000, 0, 2000, 2000)))
    assert edges.filter("size(witnesses) = 2").count() == 3  # the long side of 3 is cut where 1 meets 2
    assert claims.groupBy("face").count().filter("count > 1").isEmpty()
    assert faces.agg(F.sum("area")).first()[0] == 0


def test_slivers_go_to_the_longest_neighbour(spark):
    rings = squares(spark, (1, 0, 0, 1000, 1000), (2, 0, 1000, 1000, 1010), (3, 0, 1010, 400, 2000))
    _, traced, faces, claims = overlay(spark, rings)
    owner = ov.absorbed(claims.select("face", "rid"), faces, traced, 20000)
    assert sorted(r.rid for r in owner.collect()) == [1, 1, 3]


def nested(spark, *boxes):
    rings = squares(spark, *boxes)
    s = sp.ring_edges(rings).select(F.col("rid").alias("wid"), F.col("seq").alias("sid"), "ay", "ax", "by_", "bx")
    return rings, ov.split_at_nodes(s, 500.0)


def test_enclosed_parts_belong_to_the_face_around_them(spark):
    rings, edges = nested(spark, (1, 0, 0, 1000, 1000), (2, 200, 200, 400, 400), (3, 600, 600, 700, 700), (4, 2000, 0, 2100, 100))
    traced = ov.cycles(ov.half_edges(edges))
    sides = ov.located(traced)
    faces = ov.bounded_faces(sides, traced)
    owner = {r.rid: (r.area, r.n) for r in ov.owned(ov.claims(faces, rings), ov.ring_sizes(rings)).join(faces, "face").collect()}
    assert owner == {1: (1000000 - 40000 - 10000, 12), 2: (40000, 4), 3: (10000, 4), 4: (10000, 4)}  # the least ring names a face
    assert sides.filter("cycle IS NULL").count() == 8  # outlines of 1 and 4


def test_claims_count_under_their_parents_and_seeds_claim_faces(spark):
    rings, edges = nested(spark, (1, 0, 0, 1000, 1000), (2, 0, 500, 1000, 2000))
    traced = ov.cycles(ov.half_edges(edges))
    faces = ov.bounded_faces(ov.located(traced), traced)
    claims = ov.claims(faces, rings)
    child = spark.createDataFrame([(2, 0, 1), (1, 0, None)], "rid long, rank int, parent long")
    assert sorted((r.rid, r.area) for r in ov.owned(claims, ov.ring_sizes(rings), child).join(faces, "face").collect()) == [(1, 500000), (2, 500000)]
    water = spark.createDataFrame([(1, 1, None)], "rid long, rank int, parent long")
    assert sorted((r.rid, r.area) for r in ov.owned(claims, ov.ring_sizes(rings), water).join(faces, "face").collect()) == [(1, 500000), (2, 500000), (2, 1000000)]
    seeds = spark.createDataFrame([(9, 500.0, 1500.0)], "rid long, y double, x double")
    assert sorted(r.rid for r in ov.seeded(ov.owned(claims, ov.ring_sizes(rings), child), seeds, traced).collect()) == [1, 2, 9]


def test_healing_goes_on_to_a_fixpoint(spark):
    rings, edges = nested(spark, (1, 0, 0, 1000, 1000), (2, 3000, 0, 3100, 100))
    line = [(1000, 1000, 1400, 1400), (1400, 1400, 1500, 1500)]  # an antenna of two edges
    loop = [(3000, 2000, 3000, 2100), (3000, 2100, 3100, 2100), (3000, 2000, 3100, 2100)]  # bounds nothing claimed
    more = spark.createDataFrame([(*e, [7]) for e in line + loop], "uy long, ux long, vy long, vx long, witnesses array<long>")
    healed, _, faces, owner = ov.healed(edges.select(*more.columns).union(more), rings)
    assert healed.select(*ov.KEY).exceptAll(edges.select(*ov.KEY)).isEmpty() and healed.count() == edges.count()
    assert sorted(r.area for r in faces.collect()) == [10000, 1000000] and sorted(r.rid for r in owner.collect()) == [1, 2]


def test_enclosed_pockets_go_to_a_neighbour_whatever_their_size(spark):
    frame = [(1, 0, 0, 1000, 3000), (2, 2000, 0, 3000, 3000), (3, 1000, 0, 2000, 1000), (4, 1000, 2500, 2000, 3000)]
    rings, edges = nested(spark, *frame)
    kept, sides, faces, owner = ov.healed(edges, rings)
    pocket = faces.filter("area = 1500000").join(owner, "face")
    assert [r.rid for r in pocket.collect()] in ([1], [2]) and kept.count() == edges.count()


def test_points_in_rings(spark):
    pts = spark.createDataFrame([(1, 500, 501), (2, 1500, 501), (3, 999, 1)], "k long, y long, x long")
    got = sp.points_in_rings(pts, squares(spark, (7, 0, 0, 1000, 1000)))
    assert sorted((r.k, r.rid) for r in got.collect()) == [(1, 7), (3, 7)]


def test_simplify_rounds_go_on_until_no_segment_is_open(spark):
    """Three distant places in turn: a round sheds a vertex or two, and all of them stay."""
    rows = [(1, k, ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))[k % 3]) for k in range(200)]
    line = spark.createDataFrame(rows, "id long, seq long, v struct<x: double, y: double, z: double>")
    got = [tuple(r) for r in rg.simplified(line, "id", 0.3, short=197).collect()]
    assert sorted(got) == [(1, k) for k in range(200)]


def test_simplify_by_rounds_keeps_what_a_task_keeps(spark, sf_dir):
    from tempora.plans.spatial import path_points

    v = path_points(spark, sf_dir).select("id", "seq", "v")
    whole, rounds = rg.simplified(v, "id", 0.8), rg.simplified(v, "id", 0.8, short=0)
    assert whole.exceptAll(rounds).isEmpty() and rounds.exceptAll(whole).isEmpty()
    finer = rg.simplified(v, "id", 0.4)
    assert whole.exceptAll(finer).isEmpty() and finer.count() >= whole.count()  # monotone in the tolerance


def test_components_colours_and_thinning(spark):
    chain = spark.range(1, 60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(100, 101)], "a long, b long"))
    comp = {r.id: r.component for r in connected_components(chain).collect()}
    assert set(comp.values()) == {1, 100} and comp[60] == 1
    both = chain.union(chain.select("b", "a"))
    slots = {r.id: r.slot for r in coloured(chain.select(F.col("a").alias("id")).union(chain.select("b")).distinct(), both).collect()}
    assert all(slots[r.a] != slots[r.b] for r in chain.collect())
    line = spark.range(10).select(F.col("id").alias("k"), g.vec(F.lit(0.0), F.col("id") * 1.0).alias("v"))
    assert sorted(r.k for r in thinned(line, math.radians(1.5)).collect()) == [0, 2, 4, 6, 8]


def test_geojson_rejects_other_geometries(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"features":[{"properties":{"NAME":"p"},"geometry":{"type":"Point","coordinates":[1,2]}}]}')
    with pytest.raises(Exception, match="neither Polygon nor MultiPolygon"):
        geojson.read_polygons(spark, str(tmp_path)).collect()



def test_raster_round_trip(spark, tmp_path):
    import numpy as np

    cells = (np.arange(12) * 1000 - 5000).astype("<i2")
    (tmp_path / "g.i16").write_bytes(cells.tobytes())
    rows = raster.read_grid(spark, str(tmp_path), 4).orderBy("i", "j").collect()
    assert [r.v for r in rows] == cells.tolist() and rows[5].i == 1 and rows[5].j == 1
    raster.write_grid(spark.createDataFrame([(j // 4, j % 4, int(v)) for j, v in enumerate(cells)], "i long, j long, v long"), str(tmp_path / "again"), 4, 3)
    assert (tmp_path / "again" / "00000000.i16").read_bytes() == cells.tobytes()


def test_forged_rows_stop_the_store(spark, tmp_path):
    rows = spark.createDataFrame([("x", 1, "n", 3, 4), ("y", 2, None, 3, None)], "layer string, e long, name string, f long, u long")
    path = str(tmp_path / "store")
    store.write_store(rows, path)
    assert store.verified_store(spark, path).count() == 2 and store.forged(store.read_store(spark, path)).isEmpty()
    bad = store.read_store(spark, path).withColumn("f", F.lit(9))
    assert store.forged(bad).count() == 2


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["tag", "e", "was", "now"]
    assert set(e.oracle_sql()) <= set(e.queries())
