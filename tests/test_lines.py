"""Lines that are simplified side by side."""

import numpy as np

from tempora.operators import rings as rg


def test_lines_side_by_side_keep_what_each_keeps_alone():
    rng = np.random.default_rng(3)
    sizes = [0, 1, 2, 3, 40, 7, 90, 1]
    v = rng.normal(size=(sum(sizes), 3))
    v /= np.linalg.norm(v, axis=1)[:, None]
    v[5:20] = v[5]  # places that are equal
    offsets = np.r_[0, np.cumsum(sizes)]

    def alone(a, b, keep):
        if b - a < 2:
            return
        d = rg.distances_to_arcs(v[a + 1:b], v[a:a + 1], v[b:b + 1], np.zeros(b - a - 1, np.int64))
        m = a + 1 + int(d.argmax())
        if d[m - a - 1] > 0.3:
            keep[m] = True
            alone(a, m, keep)
            alone(m, b, keep)

    want = np.zeros(len(v), bool)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b > a:
            want[[a, b - 1]] = True
            alone(a, b - 1, want)
    assert (rg._kept(offsets, v, 0.3) == want).all() and 20 < want.sum() < len(v)
