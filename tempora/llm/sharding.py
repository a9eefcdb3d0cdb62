"""Sharding by a consistent-hash ring with virtual nodes and bounded loads (DataFrame functions only).

Every shard owns ``vnodes`` points of a 64-bit ring. A document's key is its text, so equal texts (a group) start at the
same point and stay together where the law allows. A document goes to the first virtual node clockwise; once that node's
shard holds its quota, the rest of the arc continues clockwise to the next virtual node whose shard has room. Quotas sum to
the number of rows, so row counts differ by one at most (law ``rows``), whatever the hot groups are.

Only the per-arc row counts (shards x vnodes numbers, a constant) reach the driver. Inside an arc rows are ranked in bins of
bounded size (hot bins are salted by row), and the bins' offsets are prefix sums of a small table, so no task ever holds an arc.

Defined results: null text counts as no bytes (size 16, crc 0) and forms one group; empty tables give no rows; repeated rows
each take a slot; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.plans.scratch import materialize

CELLS = 8192  # ring cells for the lookup of the next virtual node: a constant-size broadcast
ROW_OVERHEAD = 16


def _ring(spark, shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node in ring order: shards x vnodes rows."""
    pts = spark.range(shards * vnodes).select(
        F.xxhash64(F.lit("vnode"), F.col("id")).alias("p"), (F.col("id") % shards).cast("int").alias("s"))
    return sorted((r.p, r.s) for r in pts.collect())


def _flows(counts: dict[int, int], ring: list[tuple[int, int]], quota: list[int]):
    """Fill the ring clockwise. Yields (arc, first rank, end rank, shard, first slot); at most arcs + shards rows."""
    v, load = len(ring), [0] * len(quota)
    left = {a: n for a, n in counts.items() if n}
    done = dict.fromkeys(left, 0)
    for hop in range(v):
        for a in sorted(left):
            s = ring[(a + hop) % v][1]
            n = min(left[a], quota[s] - load[s])
            if n > 0:
                yield a, done[a], done[a] + n, s, load[s]
                load[s] += n
                done[a] += n
                left[a] -= n
        left = {a: n for a, n in left.items() if n}
        if not left:
            return


def shard_documents(docs: DataFrame, shards: int = 40, vnodes: int = 64, bin_rows: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of ``docs``; see the module docstring."""
    spark = docs.sparkSession
    ring = _ring(spark, shards, vnodes)
    pos = [p for p, _ in ring]
    width = 2**64 // CELLS
    lookup, k = [], 0
    for c in range(CELLS):
        end, first = -(2**63) + (c + 1) * width, k
        while k < len(pos) and pos[k] < end:
            k += 1
        lookup.append((c, first, pos[first:k]))
    cells = F.broadcast(spark.createDataFrame(lookup, "cell int, first int, inside array<bigint>"))

    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_OVERHEAD).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64("text").alias("pos"),
    )
    base = base.withColumn("cell", (F.shiftright("pos", 51) + CELLS // 2).cast("int")).join(cells, "cell")
    base = base.withColumn(
        "arc", (F.col("first") + F.size(F.filter("inside", lambda p: p < F.col("pos")))) % len(ring)
    ).select("doc_id", "size", "text_crc32", "pos", F.col("arc").cast("int").alias("arc"))
    base = materialize(base, "ring")

    counts = {r.arc: r.n for r in base.groupBy("arc").agg(F.count("*").alias("n")).collect()}  # shards x vnodes at most
    total = sum(counts.values())
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    per_bin = bin_rows or min(200_000, max(64, total // 512))
    arcs = F.broadcast(spark.createDataFrame(
        [(a, -(-n // per_bin)) for a, n in counts.items()] or [(-1, 1)], "arc int, q int"))
    binned = base.join(arcs, "arc").withColumn("bin", F.pmod(F.xxhash64(F.lit("bin"), "pos"), F.col("q")).cast("int"))
    hot = (binned.groupBy("arc", "bin").agg(F.count("*").alias("bn"))
           .filter(F.col("bn") > 2 * per_bin)
           .select("arc", "bin", F.ceil(F.col("bn") / per_bin).cast("int").alias("subs")))  # total / per_bin rows at most
    binned = (binned.join(hot, ["arc", "bin"], "left")
              .withColumn("sub", F.when(F.col("subs").isNull(), 0)
                          .otherwise(F.pmod(F.xxhash64(F.lit("sub"), "doc_id"), F.col("subs"))).cast("int"))
              .drop("q", "subs"))
    binned = materialize(binned, "binned")
    offsets = binned.groupBy("arc", "bin", "sub").agg(F.count("*").alias("n")).withColumn(
        "offset", F.coalesce(F.sum("n").over(Window.partitionBy("arc").orderBy("bin", "sub")
                                             .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    flows: dict[int, list] = {}
    for a, lo, hi, s, slot in _flows(counts, ring, quota):
        flows.setdefault(a, []).append((lo, hi, s, slot))
    flow = F.broadcast(spark.createDataFrame(
        list(flows.items()) or [(-1, [])], "arc int, flows array<struct<lo:bigint,hi:bigint,shard:int,slot0:bigint>>"))
    in_bin = Window.partitionBy("arc", "bin", "sub").orderBy("pos", "doc_id", "text_crc32", "size")
    ranked = (binned.withColumn("rn", F.row_number().over(in_bin) - 1).join(offsets, ["arc", "bin", "sub"])
              .withColumn("rank", F.col("offset") + F.col("rn")).join(flow, "arc")
              .withColumn("f", F.filter("flows", lambda f: (f["lo"] <= F.col("rank")) & (F.col("rank") < f["hi"]))[0]))
    return ranked.select("doc_id", "size", "text_crc32", F.col("f.shard").alias("shard"),
                         (F.col("f.slot0") + F.col("rank") - F.col("f.lo")).alias("slot"))


def op7_consistent_hash_shards(spark, sf_dir: str) -> DataFrame:
    """Contract query: all ``documents`` in shards 0 to 39 under the law ``rows``."""
    out = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
