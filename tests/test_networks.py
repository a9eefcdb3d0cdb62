"""Snapping, clipping, bridges and nodes on hand-made inputs."""

import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from tempora.plans import fixtures as fx
from tempora.plans import networks as nw
from tempora.plans import shapes
from tempora.sources.tables import table
from tempora.streaming.changes import change_stream
from tests.test_laws import squares


def test_snapping_splices_the_vertices_between(spark):
    ring = squares(spark, (1, 0, 0, 1000, 1000))  # (0,0) (0,1000) (1000,1000) (1000,0)
    path = [(5, 0, 10, 500), (5, 1, 500, 1020), (5, 2, 5000, 5000), (5, 3, 500, -20), (6, 0, 10, 400), (6, 1, 10, 600), (6, 2, 12, 500)]
    got = nw.snapped(spark.createDataFrame(path, "path long, seq long, y long, x long"), ring, 500.0, 100)
    rows = {}
    for r in got.orderBy("path", "place").collect():
        rows.setdefault(r.path, []).append((r.y, r.x))
    # a corner between the first two, a free point, and the corner on the way back to the start
    assert rows[5] == [(0, 500), (0, 1000), (500, 1000), (5000, 5000), (500, 0), (0, 0)]
    assert rows[6] == [(0, 400), (0, 600), (0, 500)]


def test_moved_rings_snap_back_onto_their_vertices(spark, sf_dir):
    got = nw.j9_rings(spark, sf_dir)
    n = fx.rings(spark, sf_dir).select("rid").distinct().count()
    assert got.select("path").distinct().count() == n and got.count() > 8 * n
    assert got.groupBy("path").agg(F.max("place").alias("m"), F.count("*").alias("n")).filter("m <> n").isEmpty()


def test_runs_outside_end_at_the_shore(spark):
    lake = squares(spark, (1, 0, 0, 1000, 1000))
    pts = spark.createDataFrame([(1, 1, 500, -1000), (1, 2, 500, -500), (1, 3, 500, 500), (1, 4, 500, 2000), (2, 5, 500, 600), (2, 6, 3000, 600), (3, 7, 9, 5000)],
                                "path long, k long, y long, x long")
    got = [tuple(r) for r in nw.outside_runs(pts, lake, 700.0).orderBy("path", "run", "place").collect()]
    assert got == [(1, 1, 1, 500, -1000), (1, 1, 2, 500, -500), (1, 1, 3, 500, 0), (1, 3, 1, 500, 1000), (1, 3, 2, 500, 2000),
                   (2, 2, 1, 1000, 600), (2, 2, 2, 3000, 600), (3, 1, 1, 9, 5000)]


def test_clipped_runs_agree_with_their_points(spark, sf_dir):
    runs = {(r.path, r.run): r.n for r in nw.j14(spark, sf_dir).collect()}
    pts = {(r.path, r.run): r.n for r in nw.j14_points(spark, sf_dir).groupBy("path", "run").agg(F.count("*").alias("n")).collect()}
    assert runs and set(runs) == set(pts) and all(0 <= pts[k] - n <= 2 for k, n in runs.items())


def test_bridges_are_the_shortest_chains(spark):
    parts = spark.createDataFrame([(1, 1), (2, 1), (10, 10), (20, 20)], "id long, component long")
    chain = [(2, 3), (3, 4), (4, 10), (1, 5), (5, 10), (10, 20)]
    ties = spark.createDataFrame(chain + [(b, a) for a, b in chain], "a long, b long")
    assert sorted(tuple(r) for r in nw.bridges(parts, ties).collect()) == [(1, 10, 2), (10, 20, 1)]


def test_nodes_cut_segments_in_order(spark, sf_dir):
    rows = nw.j13(spark, sf_dir).collect()
    edges = {}
    for r in rows:
        edges.setdefault((r.rid, r.seq), []).append((r.part, r.t))
    assert rows and all([p for p, _ in sorted(v)] == list(range(1, len(v) + 1)) and [t for _, t in sorted(v)] == sorted(t for _, t in v) for v in edges.values())


def test_watersheds_and_overlaps(spark, sf_dir):
    nets = nw.j22(spark, sf_dir).collect()
    k = table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 50).alias("n")).distinct().count()
    assert len(nets) == k and {r.drains for r in nets} <= {True, False}
    pairs = {(r.a, r.b) for r in shapes.j7(spark, sf_dir).collect()}
    stands = fx.standings(spark, sf_dir).select(F.col("e").alias("rid"))
    rids = {r.rid for r in fx.rings(spark, sf_dir).filter("abs(qlat) < 500000000").join(stands, "rid").select("rid").distinct().collect()}
    # a ring moved by half a cell overlaps the one that it came from, as deeply as meridians are apart there
    assert {(-r - 1, r) for r in rids} <= pairs and all(a < 0 <= b for a, b in pairs)


def test_falls_are_told_when_the_watermark_passes(spark, tmp_path):
    src, day = str(tmp_path / "src"), lambda d: pd.Timestamp(dt.datetime(2024, 1, d))
    put = lambda rows: spark.createDataFrame(pd.DataFrame(rows, columns=["key", "ts", "event_id", "body"]), "key long, ts timestamp, event_id long, body string").coalesce(1).write.mode("append").parquet(src)
    put([(1, day(1), 1, "a"), (2, day(1), 2, "a")])
    stream = spark.readStream.schema("key long, ts timestamp, event_id long, body string").parquet(src)
    go = lambda: change_stream(stream, 86400.0).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    go()
    put([(2, day(9), 3, "b")])
    go()
    put([(9, day(20), 4, "end")])
    go()
    got = {(r.key, r.kind, r.at.day) for r in spark.read.schema("key long, kind string, at timestamp, body string").parquet(str(tmp_path / "out")).collect() if r.key != 9}
    assert got == {(1, "Rise", 1), (2, "Rise", 1), (1, "Fall", 2), (2, "Fall", 2), (2, "Rise", 9), (2, "Fall", 10)}


def test_changes_are_the_same_however_rows_are_cut_into_batches(spark, tmp_path):
    """One file a trigger, rows shuffled among files, against all rows in one batch and a plain fold."""
    rng = random.Random(5)
    base = dt.datetime(2024, 1, 1)
    rows = [(k, pd.Timestamp(base + dt.timedelta(minutes=rng.randint(0, 6000))), k * 1000 + n, rng.choice("ab")) for k in range(6) for n in range(30)]
    end = (99, pd.Timestamp(base + dt.timedelta(days=60)), -1, "end")
    want = set()
    for k in range(6):
        body = seen = None
        for _, ts, _, now in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
            if seen is not None and ts - seen > pd.Timedelta(hours=5):
                want.add((k, "Fall", seen + pd.Timedelta(hours=5), body))
                seen = None
            if seen is None or body != now:
                want.add((k, "Rise" if seen is None else "Shift", ts, now))
            body, seen = now, ts
        want.add((k, "Fall", seen + pd.Timedelta(hours=5), body))
    schema = "key long, ts timestamp, event_id long, body string"

    def run(name, parts):
        src, out, cp = (str(tmp_path / f"{name}-{x}") for x in ("src", "out", "cp"))
        for part in parts:
            spark.createDataFrame(pd.DataFrame(part, columns=["key", "ts", "event_id", "body"]), schema).coalesce(1).write.mode("append").parquet(src)
        stream = change_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), 5 * 3600.0, "30 days")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        found = [(r.key, r.kind, pd.Timestamp(r.at), r.body) for r in spark.read.schema("key long, kind string, at timestamp, body string").parquet(out).collect() if r.key != 99]
        assert len(found) == len(set(found))
        return set(found)

    mixed = rows[:]
    rng.shuffle(mixed)
    assert run("one", [[*rows, end]]) == want
    assert run("cut", [mixed[:50], mixed[50:110], mixed[110:], [end]]) == want
