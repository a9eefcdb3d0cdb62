"""Edges on rivers (J21) and label anchors (W23) against plain versions."""

import math

import numpy as np

from tempora.plans import fixtures as fx
from tempora.plans.networks import near_arcs
from tempora.registry import QUERIES


def unit(lat, lon):
    a, b = math.radians(lat), math.radians(lon)
    return (math.cos(a) * math.cos(b), math.cos(a) * math.sin(b), math.sin(a))


def to_arc(p, a, b):
    """Angle from p to the arc a-b: along it where the foot lies between its ends, else to the nearer end."""
    p, a, b = map(np.array, (p, a, b))
    ends = min(math.acos(max(-1, min(1, float(p @ q)))) for q in (a, b))
    n = np.cross(a, b)
    if np.linalg.norm(n) < 1e-12:
        return ends
    n = n / np.linalg.norm(n)
    foot = p - (p @ n) * n
    between = np.linalg.norm(foot) > 1e-12 and np.cross(a, foot) @ n >= 0 and np.cross(foot, b) @ n >= 0
    return min(ends, abs(math.asin(max(-1, min(1, float(p @ n)))))) if between else ends


def test_points_near_arcs(spark):
    """Long and short arcs, the poles, the date line, points on arcs and beyond their ends."""
    rng = np.random.default_rng(8)
    ends = [(80, -170, 85, 170), (0, 179.5, 0, -179.5), (-89, 10, -89, 190), (10, 10, 10.2, 10.1), (5, 5, 5, 5), (20, 0, -30, 70)]
    ends += [(la, lo, la + rng.uniform(-3, 3), lo + rng.uniform(-3, 3)) for la, lo in zip(rng.uniform(-60, 60, 20), rng.uniform(-170, 170, 20), strict=True)]
    arcs = [(k, unit(*e[:2]), unit(*e[2:])) for k, e in enumerate(ends)]
    pts = []
    for _, a, b in arcs:
        for t in (-0.02, 0.0, 0.4, 1.01):
            v = np.array(a) * (1 - t) + np.array(b) * t + rng.normal(0, 0.006, 3)
            pts.append(tuple(float(x) for x in v / np.linalg.norm(v)))
    vec = "struct<x:double,y:double,z:double>"
    p = spark.createDataFrame(list(enumerate(pts)), f"k long, v {vec}")
    got = {tuple(r) for r in near_arcs(p, spark.createDataFrame(arcs, f"k long, v {vec}, n {vec}"), 0.01).collect()}
    far = {(i, k): to_arc(v, a, b) for i, v in enumerate(pts) for k, a, b in arcs}
    clear = {pair for pair, d in far.items() if abs(d - 0.01) > 1e-9}
    assert got & clear == {pair for pair in clear if far[pair] <= 0.01} and len(got) > 40


def test_label_anchors(spark, sf_dir):
    """Each anchor lies in its ring, its room is the distance to the border, and no point of a fine grid has 2 % more."""
    rings = {}
    for r in fx.rings(spark, sf_dir).orderBy("rid", "seq").collect():
        rings.setdefault(r.rid, []).append((float(r.qlat), float(r.qlon)))
    got = {r.rid: r for r in QUERIES["W23_label_anchor"](spark, sf_dir).collect()}
    assert set(got) == set(rings)

    def room(points, ring):
        a = np.array(ring)
        b = np.roll(a, -1, axis=0)
        d = b - a
        t = np.clip(((points[:, None] - a) * d).sum(-1) / (d * d).sum(-1), 0, 1)
        return np.sqrt(((points[:, None] - a - t[..., None] * d) ** 2).sum(-1)).min(1)

    for rid, ring in rings.items():
        low, high = np.min(ring, axis=0), np.max(ring, axis=0)
        y, x = (np.linspace(low[i], high[i], 81) for i in (0, 1))
        best = room(np.stack(np.meshgrid(y, x), -1).reshape(-1, 2), ring).max()  # these rings fill their boxes
        at = np.array([[got[rid].y, got[rid].x]])
        assert (low < at).all() and (at < high).all() and abs(room(at, ring)[0] - got[rid].room) < 1
        assert got[rid].room >= best / 1.02
