"""Rings that lie alike: cut and looked up once, and told with all their ids."""

from tempora.operators import overlay as ov
from tempora.operators import spatial as sp
from tempora.plans import networks as nw
from tests.test_laws import squares


def test_equal_segments_are_cut_once(spark, monkeypatch):
    met, plain = [], sp.segment_pairs

    def counted(left, right, *size):
        met.append(left.count())
        return plain(left, right, *size)

    monkeypatch.setattr(sp, "segment_pairs", counted)
    boxes = [(0, 0, 1000, 1000), (500, 500, 1500, 1500)]
    rings = squares(spark, *[(100 * b + i, *box) for b, box in enumerate(boxes) for i in range(20)])
    cut = lambda r: ov.split_at_nodes(sp.ring_edges(r).withColumnRenamed("rid", "wid").withColumnRenamed("seq", "sid"), 500.0).collect()
    many, one = cut(rings), cut(rings.filter("rid % 100 = 0"))
    assert met == [8, 8]
    told = lambda rows: {(r.uy, r.ux, r.vy, r.vx): list(r.witnesses) for r in rows}
    assert told(many) == {k: sorted(w + i for w in v for i in range(20)) for k, v in told(one).items()} and len(one) == 12
    assert sorted(r.rid for r in ov.first_of_equal(rings).select("rid").distinct().collect()) == [0, 100]


def test_points_snap_onto_the_first_of_equal_rings(spark, monkeypatch):
    met, plain = [], nw._near_segments

    def counted(pts, edges, *rest):
        met.append(edges.count())
        return plain(pts, edges, *rest)

    monkeypatch.setattr(nw, "_near_segments", counted)
    rings = squares(spark, *[(i, 0, 0, 1000, 1000) for i in range(3, 23)])
    path = spark.createDataFrame([(5, 0, 10, 500), (5, 1, 500, 1020), (5, 2, 5000, 5000)], "path long, seq long, y long, x long")
    got = [(r.y, r.x) for r in nw.snapped(path, rings, 500.0, 100).orderBy("place").collect()]
    assert got == [(0, 500), (0, 1000), (500, 1000), (5000, 5000)] and met == [4]
