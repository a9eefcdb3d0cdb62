"""Rings that lie alike: what depends on a ring's place alone is found once, and rows are those of the SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tempora.operators import rings as rg
from tempora.operators import spatial as sp
from tempora.plans import networks as nw
from tempora.plans import shapes
from tempora.registry import ORACLE_SQL, QUERIES
from tests.test_laws import squares
from tests.test_queries import table


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """Tables whose customers stand three times, 8,000 keys apart, so their rings lie alike."""
    at = str(tmp_path_factory.mktemp("copies"))
    i = spark.range(3).withColumnRenamed("id", "i")
    src = "/root/testdata/sf0.001"
    spark.read.parquet(f"{src}/customer.parquet").filter("c_custkey < 40").join(i).withColumn("c_custkey", F.col("c_custkey") + 8000 * F.col("i")).drop("i").write.parquet(f"{at}/customer.parquet")
    spark.read.parquet(f"{src}/orders.parquet").filter("o_custkey < 40").join(i).withColumn("o_custkey", F.col("o_custkey") + 8000 * F.col("i")).withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000 * F.col("i")).drop("i").write.parquet(f"{at}/orders.parquet")
    return at


@pytest.mark.parametrize("name", ["J5_point_in_polygon", "J6_point_ring_distance", "J7_overlap_self_join", "J8_shared_border_adjacency", "J12_segment_intersections", "A10_longest_shared_boundary", "W16_shared_arcs"])
def test_copies_give_the_rows_of_the_sql(name, spark, copies, monkeypatch):
    built, plain = [], sp.ring_edges

    def counted(rings, *rest):
        built.append(rings.select("rid").distinct().count())
        return plain(rings, *rest)

    monkeypatch.setattr(sp, "ring_edges", counted)
    c = duckdb.connect()
    for t in ("customer", "orders"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{copies}/{t}.parquet/*.parquet'")
    df = QUERIES[name](spark, copies)
    cols, found = sorted(df.columns), c.execute(ORACLE_SQL[name])
    theirs = [d[0] for d in found.description]
    want = table([r[theirs.index(x)] for x in cols] for r in found.fetchall())
    assert table([r[x] for x in cols] for r in df.collect()) == want
    assert all(n <= (120 if name == "W16_shared_arcs" else 80) for n in built[name.startswith("J7"):])  # J7 begins with all its segments, which nothing reads; 40 places, in two layers for J7


def test_users_of_an_edge_travel_as_a_digest(spark):
    rings = squares(spark, *[(i, 0, 0, 1000, 1000) for i in range(3, 43)])
    arcs = rg.shared_arcs(sp.ring_edges(rings)).collect()
    assert {len(r.users) for r in arcs} == {64} and len(arcs) == 160


def test_copies_take_all_slots_and_do_not_wait_for_each_other(spark, monkeypatch):
    """60 copies of one square and 60 of its neighbour: as many rounds as slots take, and the slots of the plain way."""
    rounds, plain = [], nw._fewer
    monkeypatch.setattr(nw, "_fewer", lambda *a: rounds.append(1) or plain(*a))
    members = spark.range(120).select("id", (F.col("id") % 2).alias("shape"))
    pairs = spark.createDataFrame([(a, b) for a in (0, 1) for b in (0, 1)], "a long, b long")
    got = {r.id: r.slot for r in nw.coloured_alike(members, pairs).collect()}
    ranks = {r.id: (r.h, r.id) for r in spark.range(120).select("id", F.xxhash64("id").alias("h")).collect()}
    want = {}
    for x in sorted(ranks, key=ranks.get):
        free = [s for s in range(8) if s not in want.values()]
        want[x] = free[x % len(free)] if free else x % 8
    assert got == want and len(rounds) <= 10


def test_near_points_are_thinned_without_their_pairs(spark, monkeypatch):
    """300 points in one spot and one beside it: pairs of all would be 45,000."""
    met, plain = [], sp.within

    def counted(*a, **k):
        out = plain(*a, **k)
        met.append(out.count())
        return out

    monkeypatch.setattr(sp, "within", counted)
    rows = [(k, (1.0, 0.0, 0.0)) for k in range(1, 301)] + [(0, (0.0, 1.0, 0.0))]
    pts = spark.createDataFrame(rows, "k long, v struct<x:double,y:double,z:double>")
    assert sorted(r.k for r in nw.thinned(pts, 0.1).collect()) == [0, 1] and sum(met) < 2000


def test_overlay_on_sphere_takes_one_ring_of_those_that_lie_alike(spark, copies, monkeypatch):
    monkeypatch.setattr(shapes.so, "overlaid", lambda arcs, *rest: arcs)
    arcs = shapes.overlaid_on_sphere(spark, copies)
    keys = [r.c_custkey for r in spark.read.parquet(f"{copies}/customer.parquet").select("c_custkey").collect()]
    # of each place in either layer the least id, which owns the faces that its like hold, too; eight arcs each
    least = {k for k in keys if k < 8000} | {-k - 1 for k in keys if k >= 16000}
    assert {r.rid: r["count"] for r in arcs.groupBy("rid").count().collect()} == dict.fromkeys(least, 8)


def test_laws_of_topology_take_rings_that_lie_alike_as_one(spark, copies):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW customer AS SELECT * FROM '{copies}/customer.parquet/*.parquet'")
    got = QUERIES["L11_topology"](spark, copies).select("law", "amount").collect()
    assert [tuple(r) for r in got] == c.execute(ORACLE_SQL["L11_topology"]).fetchall()


def test_edges_that_stand_twice_are_told_of_rings_that_differ(spark):
    alike = [(i, 0, 0, 1000, 1000) for i in (1, 2)]
    assert shapes.repeated(squares(spark, *alike)).isEmpty()
    pairs = spark.createDataFrame([(3, s, y, x) for s, (y, x) in enumerate([(0, 0), (0, 1000), (1000, 1000), (2000, 0)])], "rid long, seq long, qlat long, qlon long")
    twice = shapes.repeated(squares(spark, *alike).unionByName(pairs)).collect()
    assert {(r.oy, r.ox, r.dy, r.dx, r.n) for r in twice} == {(0, 0, 0, 1000, 2), (0, 1000, 1000, 1000, 2)}
    loop = [(0, 0), (0, 1000), (1000, 1000)]
    again = spark.createDataFrame([(4, s, y, x) for s, (y, x) in enumerate(loop + loop)], "rid long, seq long, qlat long, qlon long")
    assert shapes.repeated(again).count() == 3
