"""Whitening against exact moments and double-precision eigenvectors."""

import math

import numpy as np
import pytest

from tempora.llm import whitening

ROWS = "vec_id long, embedding array<double>, component string, n int, label int"


def integers(rows):
    return np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in rows], object)


def check(got, ids, rows, components=32, variances=None):
    """Every row against integer moments; eigenvectors by residual and orthogonality, as those of close eigenvalues aren't unique."""
    x = integers(rows)
    n, d = x.shape
    s = x.sum(0)
    far = n * x - s
    v = (far.T @ far / n**3).astype(float)
    e = np.linalg.eigvalsh(v)[::-1]
    some = [k for k in range(min(components, d)) if e[k] > e[0] * d * 2.3e-16]
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    assert set(by) == set(ids) and all(set(c) == {k + 1 for k in some} for c in by.values())
    z = np.array([[by[i][k + 1][0].whitened for k in some] for i in ids])
    assert {r.n for r in got} == {n}
    assert {i: by[i][1][0].deviation for i in ids} == {i: int((f**2).sum()) for i, f in zip(ids, far)}
    assert np.allclose([by[ids[0]][k + 1][0].explained for k in some], e[some] / e.sum(), rtol=1e-6, atol=1e-13)
    assert np.abs(z.T @ z / n - np.eye(len(some))).max() < 1e-6 and np.abs(z.mean(0)).max() < 1e-6
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-6
    centred = far.astype(float) / n  # z spans the right directions: centred^T z / n = W sqrt(e), and V W = W e
    w = centred.T @ z / n / np.sqrt(e[some])
    assert np.abs(v @ w - w * e[some]).max() < 1e-11 * e[0] and np.abs(w.T @ w - np.eye(len(some))).max() < 1e-6


@pytest.mark.parametrize("kind", ["spread", "clusters", "tiny gaps", "few rows", "correlated"])
def test_against_moments(spark, kind):
    rng = np.random.default_rng(len(kind))
    n, d = (9, 12) if kind == "few rows" else (400, 40)
    scale = {"spread": np.logspace(1, -1, d), "clusters": np.repeat([4.0, 1.0], d // 2), "tiny gaps": 3 + 1e-9 * np.arange(d), "few rows": np.ones(d), "correlated": np.ones(d)}[kind]
    y = rng.standard_normal((n, d)) * scale
    if kind == "clusters":  # signs in a design whose covariance has two eigenvalues only
        signs = np.array([[1 - 2 * (bin(i & j).count("1") & 1) for j in range(1, d + 1)] for i in range(512)])
        y, n = signs * scale, 512
    if kind == "correlated":
        y = y @ rng.standard_normal((d, d)) * 30
    df = spark.createDataFrame([(int(i), v.tolist(), "c", 1, 2) for i, v in enumerate(y)], ROWS).repartition(5)
    check(whitening.whiten(df).collect(), list(range(len(y))), y.tolist())


def test_eigenvectors_are_better_than_double():
    """A matrix of known eigenvectors: gaps from 1 to 1e-13, and equal eigenvalues."""
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.standard_normal((60, 60)))[0].astype(np.longdouble)
    for _ in range(3):
        q = q @ (1.5 * np.eye(60) - 0.5 * (q.T @ q))
    e = np.sort(np.r_[np.linspace(1, 2, 20), 3 + 1e-13 * np.arange(10), np.full(10, 0.5), 1e-7 * np.arange(1, 21)].astype(np.longdouble))[::-1]
    v = (q * e) @ q.T
    v = (v + v.T) / 2
    values, x = whitening.eigenvectors(v)
    assert np.abs(values - e).max() < 1e-17 and np.abs(x.T @ x - np.eye(60)).max() < 1e-17
    assert np.abs(v @ x - x * values).max() < 1e-17
    alone = np.flatnonzero((e >= 1) & (e <= 2))
    assert (1 - np.abs(q.T @ x)[alone, alone]).max() < 1e-16


def test_odd_rows(spark):
    """Null vectors and entries, non-finite and huge ones, lengths of their own, empty vectors, repeated and null ids; one row; nothing."""
    inf = float("inf")
    bad = [(90, None), (91, [1.0, None, 2.0]), (92, [1.0, inf, 2.0]), (93, [float("nan"), 1.0, 1.0]), (94, [1e30, 1.0, 1.0]), (95, []), (96, [5.0])]
    good = [(1, [1.0, 2.0, 3.0]), (2, [0.5, -2.0, 3.0]), (3, [4.0, 2.5, 3.0]), (4, [-1e6, 7.0, 3.0]), (4, [-1e6, 7.0, 3.0])]
    pairs = [(10, [1.0, 0.0]), (11, [0.0, 1.0]), (12, [3.0, 1.0])]
    frame = lambda rows: spark.createDataFrame([(i, v, "c", 1, 2) for i, v in rows], ROWS).repartition(4)
    got = whitening.whiten(frame(bad + good + pairs)).collect()
    three, two = [r for r in got if r.vec_id < 10], [r for r in got if r.vec_id >= 10]
    assert {(r.vec_id, r.component) for r in three} == {(i, k) for i in (1, 2, 3, 4) for k in (1, 2)} and len(three) == 10  # the third entry never varies
    x = integers([v for _, v in good])
    far = 5 * x - x.sum(0)
    assert {r.vec_id: r.deviation for r in three} == {i: int((f**2).sum()) for (i, _), f in zip(good, far)}
    check(two, [10, 11, 12], [v for _, v in pairs])
    assert whitening.whiten(frame([(1, [1.0, 2.0]), (1, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(frame(good[:1])).count() == 0 and whitening.whiten(frame(good).limit(0)).count() == 0
    assert all(r.deviation is None and math.isfinite(r.whitened) for r in whitening.whiten(frame([(1, [1e9, 2.0]), (2, [-1e9, 2.0])])).collect())
    nobody = whitening.whiten(frame([(None, [1.0]), (2, [3.0])])).collect()
    assert {r.vec_id for r in nobody} == {None, 2} and all(abs(abs(r.whitened) - 1) < 1e-15 and r.explained == 1 for r in nobody)


def test_products_are_exact():
    rng = np.random.default_rng(2)
    for most in (3, 2**19, 2**31, 2**53):
        y = rng.integers(-most, most, (200, 5))
        assert (whitening._products(y) == y.astype(object).T @ y.astype(object)).all()


def test_the_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    check(whitening.op13_refined_whitening(spark, sf_dir).collect(), [i for i, _ in rows], [v for _, v in rows])
