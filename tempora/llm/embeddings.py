"""Embedding near-dedup by randomly rotated binary codes with stored correction factors.

Each unit vector is rotated at random and stored as its code (the signs of the rotated coordinates), the factor f = <code, vector>,
and the rotated coordinates in eight bits with the length of their rounding error. <rounded a, code b> / f_b estimates the inner
product without bias; its bound is ``EPSILON`` deviations, sqrt((1 - f^2) / f^2 / (dim - 1)), and the rounding error. Pairs whose
interval lies below the threshold are dropped. Only vectors of pairs that stay open are fetched, and those pairs are recomputed
exactly in double precision, so no link is below the threshold.

Candidates meet in cells of their label and dimension (exact keys, no hashes of them). A table of cells takes the signs of ``bits``
coordinates of a rotation of its own, ``bits`` growing with the label so that a cell holds about ``CELL`` vectors; every vector also
enters the cells that flip one of its two weakest bits. Rotations are independent, so a pair at the threshold shares no cell with
probability (1 - p)^tables, p being a table's chance for that dimension and number of bits; ``tables`` is chosen to keep this below
``MISS`` at every size. Nothing is fitted and every vector is indexed. Equal vectors are one class with a count. A cell is worked in
blocks of bounded size, hot cells as pairs of blocks; blocks return counts and one link a vector to the least of its local group,
never the pairs. A pair that meets in several cells is counted in the first of them only.

Defined results: null labels, null vectors, null or non-finite components, zero vectors and vectors of another dimension link with
nothing; a null vec_id is its own row with a null component; repeated rows of one vec_id count as copies; rows of one vec_id with
different vectors are compared by their vectors, each with its own links; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.words import small_batches
from tempora.operators.graph import connected_components
from tempora.plans.scratch import drop_scratch, materialize

PROBES, EPSILON, MISS = 3, 4.0, 0.01
CELL, BLOCK = 256, 512  # vectors that a cell aims at, and that a block holds
MOST_BITS = 32
_CELL = np.dtype([("own", "<u4"), ("weak", "u1", 2)])
_ROTATIONS: dict[tuple[int, int], np.ndarray] = {}


def rotation(dim: int, number: int = 0) -> np.ndarray:
    if (dim, number) not in _ROTATIONS:
        q, r = np.linalg.qr(np.random.default_rng([dim, number]).standard_normal((dim, dim)))
        _ROTATIONS[dim, number] = q * np.sign(np.diag(r))
    return _ROTATIONS[dim, number]


def _signs(part: np.ndarray, bits: int) -> np.ndarray:
    """A table's cells of vectors, from their rotated coordinates: the own one and the bits to flip, weakest first."""
    out = np.zeros(len(part), _CELL)
    if bits:
        out["own"] = ((part[:, :bits] > 0).astype(np.int64) << np.arange(bits)).sum(1)
        weak = np.argsort(np.abs(part[:, :bits]), axis=1)
        out["weak"][:, 0], out["weak"][:, 1] = weak[:, 0], weak[:, min(1, bits - 1)]
    return out


def _numbers(cells: np.ndarray, bits: int) -> np.ndarray:
    """(vector, table, probe) cell numbers that know their table, from packed cells (vector, table)."""
    own = cells["own"].astype(np.int64)
    probes = [own, *(own ^ (np.int64(1) << cells["weak"][:, :, k].astype(np.int64)) for k in (0, 1))] if bits else [own] * PROBES
    return np.stack(probes, 2) | (np.arange(cells.shape[1], dtype=np.int64) << 32)[None, :, None]


def tables_for(dim: int, bits: int, threshold: float) -> int:
    """Tables that leave a pair at the threshold apart with probability below ``MISS``."""
    if not bits:
        return 1
    rng = np.random.default_rng([dim, bits])
    x = rng.standard_normal((4000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((4000, dim))
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300)
    y = threshold * x + math.sqrt(max(0.0, 1 - threshold**2)) * z
    a, b = (_numbers(_signs(v, bits)[:, None], bits)[:, 0] for v in (x, y))
    share = (a[:, :, None] == b[:, None, :]).any((1, 2)).mean()
    share = max(0.01, share - 2 * math.sqrt(share * (1 - share) / 4000))
    return 1 if share >= 1 else max(1, math.ceil(math.log(MISS) / math.log(1 - share)))


def _placed(reps: DataFrame, tables: dict[tuple[int, int], int]) -> DataFrame:
    """cid, grp, dim, bits, copies, code, factor, coords, scale, error, cells, keys of every class."""

    def run(batches):
        for b in batches:
            kinds = np.stack([b.column("dim").to_numpy(), b.column("bits").to_numpy()], 1)
            for dim, bits in np.unique(kinds, axis=0).tolist():
                rows = b.filter(pa.array((kinds == (dim, bits)).all(1)))
                x = unit(rows.column("embedding"), dim)
                turned = x @ rotation(dim)
                code = np.where(turned > 0, 1.0, -1.0) / math.sqrt(dim)
                scale = np.maximum(np.abs(turned).max(1), 1e-300) / 127
                coords = np.rint(turned / scale[:, None]).astype(np.int8)
                error = np.linalg.norm(turned - coords * scale[:, None], axis=1)
                cells = np.stack([_signs(x @ rotation(dim, t + 1), bits) for t in range(tables[dim, bits])], 1)
                keys = [np.unique(k) for k in _numbers(cells, bits).reshape(len(x), -1)]
                texts = [[r.tobytes() for r in np.ascontiguousarray(v)] for v in (np.packbits(turned > 0, axis=1), coords, cells)]
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(c) for c in ("cid", "grp", "dim", "bits", "copies")), pa.array(texts[0], pa.binary()), pa.array(np.einsum("ij,ij->i", code, turned)),
                     pa.array(texts[1], pa.binary()), pa.array(scale), pa.array(error), pa.array(texts[2], pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    ["cid", "grp", "dim", "bits", "copies", "code", "factor", "coords", "scale", "error", "cells", "keys"])

    return reps.mapInArrow(run, "cid long, grp long, dim int, bits int, copies long, code binary, factor double, coords binary, scale double, error double, "
                                "cells binary, keys array<bigint>")


def unit(column, dim: int) -> np.ndarray:
    """Rows of unit length from a list column or a series of arrays, safe against overflow."""
    flat = column.flatten().to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else np.concatenate(column.to_list())
    x = flat.astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least cell number that both vectors of each pair are in."""
    common = (a[:, :, :, None] == b[:, :, None, :]).any(3)
    return np.where(common, a, np.iinfo(np.int64).max).reshape(len(a), -1).min(1)


def _here(pdf: pd.DataFrame, key: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs meet in this cell first."""
    cells = _numbers(np.stack([np.frombuffer(c, _CELL) for c in pdf["cells"]]), int(pdf["bits"].iloc[0]))
    return np.concatenate([np.zeros(0, bool), *(_first_shared(cells[i[k:k + 50_000]], cells[j[k:k + 50_000]]) == key for k in range(0, len(i), 50_000))])


def _sides(key, pdf: pd.DataFrame):
    side = pdf["block"].to_numpy()
    return np.flatnonzero(side == key[2]), np.flatnonzero(side == key[3])


def _open(threshold: float):
    def rows(key, pdf: pd.DataFrame) -> pd.DataFrame:
        """The block's rows that have a pair whose interval reaches the threshold and that meets here first."""
        left, right = _sides(key, pdf)
        dim = int(pdf["dim"].iloc[0])
        code = np.unpackbits(np.stack([np.frombuffer(c, np.uint8) for c in pdf["code"]]), axis=1)[:, :dim] * 2.0 - 1.0
        near = np.stack([np.frombuffer(c, np.int8) for c in pdf["coords"]]) * pdf["scale"].to_numpy()[:, None]
        f, error = np.maximum(pdf["factor"].to_numpy(), 1e-9), pdf["error"].to_numpy()
        slack = EPSILON * np.sqrt(np.maximum(0, 1 - f**2)) / f / math.sqrt(max(1, dim - 1))
        estimate = near[left] @ code[right].T / math.sqrt(dim) / f[right]
        i, j = np.nonzero(estimate + slack[right] + error[left][:, None] / f[right] >= threshold)
        i, j = left[i], right[j]
        some = i != j
        i, j = i[some], j[some]
        here = _here(pdf, key[1], i, j)
        alive = np.unique(np.r_[i[here], j[here]])
        return pdf.iloc[alive][["cid", "block"]].assign(grp=key[0], key=key[1], one=key[2], two=key[3])

    return rows


def _linked(threshold: float):
    def links(key, pdf: pd.DataFrame) -> pd.DataFrame:
        """cid, n, root: exact links counted in this block, and the least cid of its local group."""
        left, right = _sides(key, pdf)
        x = unit(pdf["embedding"], int(pdf["dim"].iloc[0]))
        cid, copies = pdf["cid"].to_numpy(), pdf["copies"].to_numpy()
        i, j = np.nonzero(x[left] @ x[right].T >= threshold - 1e-9)
        i, j = left[i], right[j]
        some = cid[i] < cid[j] if key[2] == key[3] else np.ones(len(i), bool)
        i, j = i[some], j[some]
        near = np.concatenate([np.zeros(0, bool), *(np.einsum("ij,ij->i", x[i[k:k + 50_000]], x[j[k:k + 50_000]]) >= threshold for k in range(0, len(i), 50_000))])
        i, j = i[near], j[near]
        here = _here(pdf, key[1], i, j)
        i, j = i[here], j[here]
        n = np.bincount(i, copies[j], len(cid)) + np.bincount(j, copies[i], len(cid))
        root = cid.copy()
        while len(i):
            low = np.minimum(root[i], root[j])
            before = root.copy()
            np.minimum.at(root, i, low)
            np.minimum.at(root, j, low)
            if (before == root).all():
                break
        has = n > 0
        return pd.DataFrame({"cid": cid[has], "n": n[has].astype(np.int64), "root": root[has]})

    return links


def near_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row; cosine >= threshold within equal, non-null labels."""
    small_batches(vectors.sparkSession)
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite
                        & F.exists("embedding", lambda v: v != 0), F.lit(False))
    ids = [F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(7), "embedding").alias("h2")]
    base = materialize(base.select("*", usable.alias("usable"), *ids), "vectors")
    fit = base.filter("usable")
    classes = fit.groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    classes = materialize(classes.withColumn("dim", F.size("embedding")).withColumn("cid", F.monotonically_increasing_id()), "classes")
    bits = F.greatest(F.lit(0), F.least(F.lit(MOST_BITS), F.col("dim"), F.ceil(F.log2(F.count("*") / F.lit(CELL))))).cast("int")
    groups = materialize(classes.groupBy("label", "dim").agg(bits.alias("bits")).withColumn("grp", F.monotonically_increasing_id()), "groups")
    kinds = groups.select("dim", "bits").distinct().collect()  # as many as dimensions times MOST_BITS at most
    tables = {(r.dim, r.bits): tables_for(r.dim, r.bits, threshold) for r in kinds}
    placed = materialize(_placed(classes.join(groups, ["label", "dim"]).select("cid", "grp", "dim", "bits", "copies", "embedding"), tables), "placed")
    inside = placed.select("*", F.explode("keys").alias("key")).drop("keys", "copies")
    sizes = placed.select("grp", F.explode("keys").alias("key")).groupBy("grp", "key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("m")).filter("m > 1")
    mine = inside.join(sizes, ["grp", "key"]).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    both = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    both = both.withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other")).drop("other", "blocks", "m")
    where = ["grp", "key", "one", "two"]
    alive = materialize(both.groupBy(*where).applyInPandas(_open(threshold), "cid long, block int, grp long, key long, one int, two int"), "open")
    whole = classes.select("cid", "embedding", "dim").join(placed.select("cid", "bits", "copies", "cells"), "cid")
    found = materialize(alive.join(whole, "cid").groupBy(*where).applyInPandas(_linked(threshold), "cid long, n long, root long"), "found")
    components = connected_components(found.filter("cid <> root").select(F.col("cid").alias("a"), F.col("root").alias("b")))
    totals = found.groupBy("cid").agg(F.sum("n").alias("n"))
    told = (classes.select("label", "h1", "h2", "cid", "least", "copies").join(totals, "cid", "left")
            .join(components.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid")))
    first = told.groupBy("component").agg(F.min("least").alias("component_id"))
    told = told.join(first, "component").select("label", "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = fit.select("vec_id", "label", "h1", "h2").join(told, ["label", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = base.filter(~F.col("usable")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = materialize(linked.unionByName(alone), "near")
    for t in (base, classes, groups, placed, alive, found):
        drop_scratch(t)
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op9_rotated_code_near_vectors(spark, sf_dir: str) -> DataFrame:
    """Contract query: all rows of ``embeddings``, cosine 0.93 within labels."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
