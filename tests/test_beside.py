"""Points beside arcs of other paths, without pairs where cells settle them."""

import numpy as np
from pyspark.sql import functions as F

from tempora.plans import networks as nw


def test_points_that_cells_settle_meet_no_arcs(spark, monkeypatch):
    met, plain = [], nw.near_arcs

    def counted(pts, arcs, radius, **how):
        met.append(pts.count())
        return plain(pts, arcs, radius, **how)

    monkeypatch.setattr(nw, "near_arcs", counted)
    rng = np.random.default_rng(3)
    unit = lambda p: tuple(float(c) for c in np.array(p) / np.linalg.norm(p))
    near = [unit(np.array([1, 0.2, 0.1]) + rng.normal(0, 0.02, 3)) for _ in range(60)]
    far = [unit(rng.normal(0, 1, 3)) for _ in range(8)]
    vec = "struct<x:double,y:double,z:double>"
    ends = [((i % 7, i), a, b) for i, (a, b) in enumerate(zip(near, near[1:] + near[:1], strict=True))] + [((9, i), p, unit(np.array(p) + 0.03)) for i, p in enumerate(far)]
    arcs = spark.createDataFrame(ends, f"k struct<id:long,seq:long>, v {vec}, n {vec}")
    pts = arcs.select("k", "v")
    got = sorted((r.k.id, r.k.seq) for r in nw.beside_others(pts, arcs, 0.01).collect())
    want = sorted((r.id, r.seq) for r in plain(pts, arcs, 0.01).filter("a.id <> b.id").select("a.*").distinct().collect())
    assert got == want and len(got) == len(set(got)) > 40 and 0 < met[0] < len(ends) - 30
    assert nw.beside_others(pts.filter(F.col("k.id") == 9), arcs.filter(F.col("k.id") == 9), 0.01).count() == 0
