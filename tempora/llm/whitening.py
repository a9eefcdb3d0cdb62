"""Whitening of embeddings: exact distributed moments, then eigenvectors refined in mixed precision.

Entries become integers, so the moments are exact. A first pass sums the entries of each dimension; a second pass takes the rounded
means off and sums the products of what is left, so nothing large is multiplied and n^2 times the covariance is known as an integer.
Tasks hold one sum of d x d numbers, and partial sums meet by their place in the matrix, never as whole matrices in one task; the
driver gets the d x d result, whose size doesn't depend on the rows.

The eigenvectors start as float32 ones of the covariance. Each Ogita-Aishima step measures how far X^T X is from the identity and
X^T V X from a diagonal, both in extended precision, and corrects X by one matrix multiplication; convergence is quadratic. Pairs of
eigenvalues too close for the step (closer than its own error bound) are clusters: for these V is solved again inside the subspace they span,
shifted by their mean, and the rotated vectors go on. Steps end when what is left stops shrinking, below double precision.

Vectors of each length are whitened by themselves. Whitened values are computed a batch at a time; their covariance is summed in a
pass of its own and compared with the identity.

Defined results: rows whose vector is null or holds null or non-finite entries give no rows, nor do entries whose integer doesn't fit
53 bits (about 1.4e14); components without variance (below the rounding of the largest) can't be scaled and are left out, so one vector,
equal vectors and vectors of no entries give no rows; repeated rows count and return as often as they stand; null vec_ids stay; empty
tables give no rows; other columns are ignored. A deviation beyond 64 bits is null.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.words import small_batches

OFFSET, STEP, COMPONENTS = 1_000_000, 64, 32
STEPS = 100  # of the refinement, which takes about five; more is an error
_EXACT = 2.0**53
_PARTS = "dim int, i int, j int, high long, low long"


def _integers(batch: pa.RecordBatch):
    """(dim, vec_ids, integers) of the batch's rows of each length."""
    vectors = batch.column("embedding")
    size = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    at = np.cumsum(size) - size
    for dim in np.unique(size):
        mine = np.flatnonzero(size == dim)
        c = flat[at[mine][:, None] + np.arange(dim)]
        yield int(dim), batch.column("vec_id").take(pa.array(mine)), np.floor(STEP * c).astype(np.int64) + OFFSET


def _parted(total: dict[int, np.ndarray]):
    """Exact sums (arrays of Python or 64-bit integers, by length) as rows."""
    for dim, m in total.items():
        i, j = np.indices(m.shape).reshape(2, -1)
        v = m.reshape(-1).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), dim, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                                          pa.array([int(x) >> 32 for x in v], pa.int64()), pa.array([int(x) & 0xFFFFFFFF for x in v], pa.int64())], ["dim", "i", "j", "high", "low"])


def _summed(parts: DataFrame) -> dict[int, dict[tuple[int, int], int]]:
    """Sums by length and place; as many numbers as the matrices of all lengths have."""
    out: dict[int, dict[tuple[int, int], int]] = {}
    for r in parts.groupBy("dim", "i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).toLocalIterator():
        out.setdefault(r.dim, {})[r.i, r.j] = (r.high << 32) + r.low
    return out


def _first_sums(batches):
    """Row 0: the sums of each dimension; row 1, column 0: the number of vectors."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for dim, _, x in _integers(b):
            t = total.setdefault(dim, np.zeros((2, max(dim, 1)), object))
            t[0, :dim] += [int(v) for v in (x >> 26).sum(0)] * np.array(1 << 26, object) + (x & ((1 << 26) - 1)).sum(0).astype(object) if dim else 0
            t[1, 0] += len(x)
    yield from _parted(total)


def _products(y: np.ndarray) -> np.ndarray:
    """y^T y in exact integers: by floating multiplication where it can't round, else by digits of 20 bits."""
    most = int(np.abs(y).max(initial=0))
    if most**2 * len(y) < _EXACT:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    digits = [((y >> (20 * k)) & 0xFFFFF if 20 * (k + 1) < most.bit_length() + 1 else y >> (20 * k)).astype(np.float64) for k in range(-(-(most.bit_length() + 1) // 20))]
    out = np.zeros((y.shape[1],) * 2, object)
    for k, one in enumerate(digits):
        for m, two in enumerate(digits):
            out += (one.T @ two).astype(np.int64).astype(object) * (1 << (20 * (k + m)))
    return out


def _second_sums(near: dict[int, np.ndarray]):
    """Products of what is left of the vectors without ``near``, their rounded means."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for dim, _, x in _integers(b):
                if dim in near:
                    for k in range(0, len(x), 4096):
                        p = _products(x[k:k + 4096] - near[dim])
                        total[dim] = total[dim] + p if dim in total else p
        yield from _parted(total)

    return run


def _measured(v: np.ndarray, x: np.ndarray, scale):
    """x by falling eigenvalue, those values, what x^T x and x^T v x are short of identity and diagonal, and how close values may be told apart."""
    r = np.eye(len(v), dtype=v.dtype) - x.T @ x
    s = x.T @ v @ x
    s = (s + s.T) / 2  # else rounding over a small gap would undo orthogonality
    e = np.diag(s) / (1 - np.diag(r))
    order = np.argsort(-e, kind="stable")
    x, e, r, s = x[:, order], e[order], r[order][:, order], s[order][:, order]
    return x, e, r, s, 2 * (np.sqrt(((s - np.diag(e)) ** 2).sum()) + scale * np.sqrt((r**2).sum()))


def _refined(v: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Ogita-Aishima steps from approximate eigenvectors x, each after sub-solves of the clusters that it can't tell apart."""
    scale, least, one = np.abs(v).sum(1).max(), math.inf, np.eye(len(v), dtype=v.dtype)
    for _ in range(STEPS):
        x, e, r, s, bound = _measured(v, x, scale)
        cut = np.flatnonzero(np.r_[True, e[:-1] - e[1:] > bound, True])
        for a, b in zip(cut[:-1], cut[1:]):
            if b - a > 1:  # v inside the span, without what its eigenvalues share
                q = x[:, a:b]
                q = q @ (one[a:b, a:b] + r[a:b, a:b] / 2)
                inner = q.T @ (v @ q) - e[a:b].mean() * (q.T @ q)
                size = np.abs(inner).max()
                x[:, a:b] = q @ np.linalg.eigh((inner / size if size else inner).astype(np.float64))[1][:, ::-1].astype(v.dtype)
        x, e, r, s, bound = _measured(v, x, scale)
        gap = e[None, :] - e[:, None]
        off = s + e[None, :] * r
        np.fill_diagonal(off, 0)
        apart = np.abs(gap) > bound
        x = x + x @ np.where(apart, off / np.where(apart, gap, 1), r / 2)
        left = float(max(np.abs(off).max() / scale, np.abs(r).max()))
        if left < 1e-18 or (left < 1e-15 and left > least / 2):
            return x
        least = min(least, left)
    raise ArithmeticError("the refinement of eigenvectors does not converge")


def eigenvectors(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, in extended precision."""
    v = v.astype(np.longdouble)
    size = np.abs(v).max(initial=0)
    if not size:
        return np.zeros(len(v), np.longdouble), np.eye(len(v), dtype=np.longdouble)
    v = v / size
    x = _refined(v, np.linalg.eigh(v.astype(np.float32))[1][:, ::-1].astype(np.longdouble))
    x = x + x @ (np.eye(len(v), dtype=v.dtype) - x.T @ x) / 2  # a last step may turn close vectors by more than it knows
    e = (x * (v @ x)).sum(0)
    order = np.argsort(-e, kind="stable")
    return e[order] * size, x[:, order]


class Fit:
    """What whitening needs for vectors of one length: n, sums, near (rounded means), rest (sums less n near), variances and components."""

    def __init__(self, dim: int, n: int, sums: list[int]):
        self.dim, self.n, self.sums = dim, n, sums
        self.near = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
        self.rest = [s - n * int(m) for s, m in zip(sums, self.near)]

    def solve(self, products: dict[tuple[int, int], int], components: int) -> None:
        n, d = self.n, self.dim
        exact = [[n * products[i, j] - self.rest[i] * self.rest[j] for j in range(d)] for i in range(d)]
        v = np.array([[np.longdouble(x >> 64) * np.longdouble(2.0)**64 + np.longdouble(x & (2**64 - 1)) for x in row] for row in exact]) / np.longdouble(n) / np.longdouble(n)
        e, x = eigenvectors(v)
        trace = float(Fraction(sum(exact[i][i] for i in range(d)), n * n))
        some = e[:components] > e[0] * d * np.finfo(np.float64).eps if trace > 0 else np.zeros(0, bool)
        self.variances = e[:components][some].astype(np.float64)
        self.explained = self.variances / trace if trace > 0 else self.variances
        self.turn = (x[:, :components][:, some] / np.sqrt(e[:components][some])).astype(np.float64)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x - self.near - np.array([float(Fraction(r, self.n)) for r in self.rest])) @ self.turn

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 over dimensions, exact; None beyond 64 bits."""
        far = np.abs(x - self.near).max(initial=0) + 1
        if float(far) ** 2 * float(self.n) ** 2 * max(1, self.dim) < 2.0**62:
            return ((self.n * (x - self.near) - np.array(self.rest, np.int64)) ** 2).sum(1).tolist()
        out = ((self.n * (x - self.near).astype(object) - np.array(self.rest, object)) ** 2).sum(1)
        return [v if v < 2**63 else None for v in out]


def _spreads(fits: dict[int, Fit]):
    """Number, sums and products of whitened vectors, by length: rows i, j of the products, sums in column -1."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for dim, _, x in _integers(b):
                if dim in fits:
                    z = fits[dim].whitened(x)
                    z = np.c_[z, np.ones(len(z))]
                    total[dim] = total.get(dim, 0) + z.T @ z
        for dim, m in total.items():
            i, j = np.indices(m.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, dim, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(m.reshape(-1))], ["dim", "i", "j", "v"])

    return run


def _rows(fits: dict[int, Fit], errors: dict[int, float]):
    def run(batches):
        for b in batches:
            for dim, ids, x in _integers(b):
                if dim not in fits:
                    continue
                fit = fits[dim]
                k = len(fit.variances)
                each = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), fit.n)),
                     pa.array(fit.deviations(x), pa.int64()).take(pa.array(each)), pa.array(fit.whitened(x).reshape(-1)), pa.array(np.tile(fit.explained, len(x))), pa.array(np.full(len(each), errors[dim]))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def fitted(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """The fit of each length of vectors that has variance; ``vectors`` as :func:`usable` gives them."""
    fits = {}
    for dim, sums in _summed(vectors.mapInArrow(_first_sums, _PARTS)).items():
        if dim:
            fits[dim] = Fit(dim, sums[1, 0], [sums[0, j] for j in range(dim)])
    products = _summed(vectors.mapInArrow(_second_sums({d: f.near for d, f in fits.items()}), _PARTS)) if fits else {}
    for dim, fit in fits.items():
        fit.solve(products[dim], components)
    return {dim: fit for dim, fit in fits.items() if len(fit.variances)}


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows whose entries are all finite."""
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return base.filter(F.col("embedding").isNotNull() & F.forall("embedding", lambda c: F.coalesce(F.abs(c) < (2.0**53 - OFFSET) / STEP, F.lit(False))))


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error; see the module docstring."""
    small_batches(vectors.sparkSession)
    rows = usable(vectors)
    fits = fitted(rows, components)
    spread: dict[int, np.ndarray] = {dim: np.zeros((len(f.variances) + 1,) * 2) for dim, f in fits.items()}
    for r in rows.mapInArrow(_spreads(fits), "dim int, i int, j int, v double").groupBy("dim", "i", "j").agg(F.sum("v").alias("v")).toLocalIterator():
        spread[r.dim][r.i, r.j] = r.v
    errors = {dim: float(np.abs(m[:-1, :-1] / m[-1, -1] - np.outer(m[-1, :-1], m[-1, :-1]) / m[-1, -1] ** 2 - np.eye(len(m) - 1)).max()) for dim, m in spread.items()}
    return rows.mapInArrow(_rows(fits, errors), "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op13_refined_whitening(spark, sf_dir: str) -> DataFrame:
    """Contract query: all ``embeddings``, 32 components."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
