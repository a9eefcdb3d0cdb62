"""Contour segments and rings against a plain walk."""

import random

from tempora.operators import contours as ct

GRID = "i long, j long, v long"


def walked(segments, least):
    """Closed chains, an element at a time, each from its least side."""
    nxt = {tuple(s.h): (tuple(s.nxt), (s.y, s.x)) for s in segments}
    assert len(nxt) == len(segments)
    rings = []
    while nxt:
        start = h = min(nxt)
        ring = []
        while h in nxt:
            to, p = nxt.pop(h)
            ring.append(p)
            h = to
        if h == start and len(ring) >= least:
            rings.append((start, ring))
    return rings


def area(ring):
    return sum(a[1] * b[0] - b[1] * a[0] for a, b in zip(ring, ring[1:] + ring[:1])) / 2


def rings_of(df, level, least=8):
    out = {}
    for r in ct.contour_rings(df, level, least).orderBy("place").collect():
        assert r.place == len(out.setdefault(tuple(r.ring), []))
        out[tuple(r.ring)].append((r.y, r.x))
    return out


def test_rings_are_those_of_a_walk(spark):
    """A rough grid with saddles, missing cells and values equal to the level; high ground lies on the right."""
    rng = random.Random(7)
    cells = {(i, j): rng.choice([100, 300, 500, 700, 900]) for i in range(24) for j in range(24) if rng.random() < 0.97}
    df = spark.createDataFrame([(i, j, v) for (i, j), v in cells.items()], GRID).repartition(4)
    segments = ct.contour_segments(df, 500.0).collect()
    for least in (3, 8):
        want = dict(walked(segments, least))
        assert want and rings_of(df, 500.0, least) == want
    assert sum(map(len, dict(walked(segments, 1)).values())) == len(segments)  # contours close along the grid's edge


def test_a_hill_is_one_ring_and_a_hole_runs_the_other_way(spark):
    """A hill of 300 on a plain, with a pit on top."""
    v = lambda i, j: 0 if (i - 6) ** 2 + (j - 6) ** 2 > 16 else 300 if (i, j) != (6, 6) else 0
    df = spark.createDataFrame([(i, j, v(i, j)) for i in range(12) for j in range(12)], GRID)
    got = sorted((area(r), len(r)) for r in rings_of(df, 150.0, 4).values())
    assert len(got) == 2 and got[0][0] < 0 < got[1][0] and got[1][1] == 4
    assert len(rings_of(df, 150.0)) == 1  # the pit's ring has fewer than eight points
    assert len(rings_of(df, -10.0)) == 1 and rings_of(df, 301.0) == {}


def test_open_chains_are_left_out(spark):
    long = [(k, k + 1) for k in range(100)]
    rows = [*long, (200, 201), (201, 202), (202, 200), (300, 300), (400, 401)]
    df = spark.createDataFrame(rows, "h long, nxt long")
    assert sorted(r.h for r in ct.closed(df).collect()) == [200, 201, 202, 300]
    got = sorted((r.cycle, r.place, r.h, r.size) for r in ct.ranked(ct.closed(df)).collect())
    assert got == [(200, 0, 200, 3), (200, 1, 201, 3), (200, 2, 202, 3), (300, 0, 300, 1)]


def test_rounds_broadcast_no_side(spark, monkeypatch):
    """What grows with the grid is never gathered in the driver, however small the session takes it to be."""
    from tempora.operators import contours, overlay

    joins = []

    def seen(df, name="t"):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        joins.extend(x for x in plan.splitlines() if "Join " in x)
        return materialize(df, name)

    materialize = contours.materialize
    monkeypatch.setattr(contours, "materialize", seen)
    monkeypatch.setattr(overlay, "materialize", seen)
    grid = spark.createDataFrame([(i, j, 900 if 3 <= i <= 6 and 3 <= j <= 6 else 100) for i in range(10) for j in range(10)], "i long, j long, v long")
    assert contours.contour_rings(grid, 500.0).count() == 16
    assert len(joins) > 5 and all("strategy=merge" in x for x in joins)
