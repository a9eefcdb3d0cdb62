"""Benchmark decontamination (DataFrame functions only): SimHash over item-sized windows, confirmed by shingle similarity.

1. Windows: a document's window of an item's length can reach the similarity only if enough of its word shingles are the item's.
   Item shingles are looked for at every ``stride``-th position of each document, the stride being small enough that no window
   that reaches the similarity can slip through; window starts with too many misses among their sampled positions fall away.
2. Fingerprints: each remaining window and each item gets a 64-bit SimHash of its weighted shingles (weight: occurrences).
3. Multi-index: fingerprints are cut into ``RADIUS + 1`` blocks; two that differ in at most ``RADIUS`` bits agree on a block. Each
   window's blocks meet those of the items whose shingles it holds, so the join finds every such pair within the radius and its
   size goes with the seeds, not with windows times items.
4. Pairs within the radius are verified exactly: sum of least weights over sum of greatest weights.

Words are runs of letters and digits, lower-cased. At similarity 0.8 fingerprints differ in 9.7 bits on average with deviation 2.9.

Items of fewer than five words have no shingle: their whole word sequence counts as one, so they are found where it stands unchanged
(similarity 1), by a join of documents' runs of as many words with them.

Defined results: null or wordless documents and items match nothing; a benchmark without items gives no rows; repeated documents give equal rows once; a null doc_id is reported as null; rows of one doc_id (or of none) with different
texts are judged by their texts; other columns are ignored. ``without_leaks`` drops exactly the rows whose own text holds an item.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.plans.scratch import drop_scratch, materialize

SHINGLE, RADIUS = 5, 19
SMALL = 500_000  # shingles of a benchmark up to which they are broadcast


def words(text):
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _shingle(array: str, at):
    return F.xxhash64(*[F.get(F.col(array), at + k) for k in range(SHINGLE)])


def _sequence(array: str, at, n: int):
    """Two hashes of ``n`` words from ``at`` on, with their number."""
    return F.struct(*[F.xxhash64(F.lit(n), F.lit(seed), *[F.get(F.col(array), at + k) for k in range(n)]).alias(f"q{seed}") for seed in (1, 2)])


def _runs(n: int):
    """Every run of ``n`` words of ``w`` with its start; null where there are fewer."""
    return F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.struct(i.alias("s"), _sequence("w", i, n).alias("q"))))


def _short_items(rows: DataFrame, benchmark: DataFrame) -> DataFrame | None:
    """dk, doc_id, item_id, x (similarity, -s, n) of the first place of every item of one to ``SHINGLE - 1`` words; None without such items."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("w")).filter(F.size("w").between(1, SHINGLE - 1))
    lengths = sorted(r.n for r in items.select(F.size("w").alias("n")).distinct().collect())  # four at most
    if not lengths:
        return None
    named = [items.filter(F.size("w") == n).select("item_id", F.lit(n).alias("n"), _sequence("w", F.lit(0), n).alias("q")) for n in lengths]
    runs = [_runs(n) for n in lengths]
    wanted = named[0]
    for more in named[1:]:
        wanted = wanted.unionByName(more)
    wanted = materialize(wanted.distinct(), "short")
    asked = wanted.select("q").distinct()
    asked = F.broadcast(asked) if asked.count() <= SMALL else asked
    none = F.array().cast("array<struct<s:int,q:struct<q1:bigint,q2:bigint>>>")
    spoken = rows.select("dk", "doc_id", F.explode(F.flatten(F.array(*[F.coalesce(r, none) for r in runs]))).alias("x")).select("dk", "doc_id", "x.s", "x.q")
    first = spoken.join(asked, "q").groupBy("dk", "q").agg(F.min("s").alias("s"), F.first("doc_id").alias("doc_id"))
    return first.join(wanted, "q").select("dk", "doc_id", "item_id", F.struct(F.lit(1.0).alias("similarity"), (-F.col("s")).alias("s"), F.col("n")).alias("x"))


def _misses(m: int, similarity: float) -> int:
    """How many of a window's ``m`` shingles may be foreign if it reaches the similarity with an item of as many."""
    return m - math.ceil(round(2 * similarity / (1 + similarity) * m, 9))


def _stride(m: int, similarity: float) -> int:
    """Some run of that many shingles in a row is the item's, wherever the foreign ones lie."""
    k = _misses(m, similarity)
    return -(-(m - k) // (k + 1))


def _fingerprint(key: list[str], rows: DataFrame, keep: list[str]) -> DataFrame:
    """SimHash of each key's rows of (h): two 31-bit counters a sum."""
    bit = lambda j: F.shiftrightunsigned("h", j).bitwiseAND(1)
    sums = [F.sum(bit(2 * k) + F.shiftleft(bit(2 * k + 1), 32)).alias(f"b{k}") for k in range(32)]
    got = rows.groupBy(*key).agg(F.count("*").alias("weight"), *[F.first(c).alias(c) for c in keep], *sums)
    lanes = [F.shiftright(f"b{j // 2}", 32) if j % 2 else F.col(f"b{j // 2}").bitwiseAND((1 << 31) - 1) for j in range(64)]
    bits = [F.shiftleft((2 * lane > F.col("weight")).cast("long"), j) for j, lane in enumerate(lanes)]
    fp = bits[0]
    for b in bits[1:]:
        fp = fp.bitwiseOR(b)
    return got.select(*key, *keep, fp.alias("fp"))


def _blocks(df: DataFrame) -> DataFrame:
    """A row for each of the RADIUS + 1 blocks of the fingerprint."""
    cuts = [64 * k // (RADIUS + 1) for k in range(RADIUS + 2)]
    parts = [F.shiftrightunsigned("fp", lo).bitwiseAND((1 << (hi - lo)) - 1) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    return df.select("*", F.posexplode(F.array(*parts)).alias("block", "part"))


def _key():
    return F.xxhash64("doc_id", "text")


def _leaks(docs: DataFrame, benchmark: DataFrame, similarity: float) -> DataFrame:
    """dk (hash of doc_id and text), doc_id, item_id, start, n_words, similarity: see find_leaks."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("w")).filter(F.size("w") >= SHINGLE)
    items = materialize(items.withColumn("n", F.size("w")).select(
        "item_id", "n", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - SHINGLE), lambda i: _shingle("w", i))).alias("at", "h"))
        .dropDuplicates(["item_id", "at"]), "items")
    lengths = [r.n for r in items.select("n").distinct().collect()]  # as many as item lengths, not items
    counts = {n: n - SHINGLE + 1 for n in lengths}
    stride = min([_stride(m, similarity) for m in counts.values()], default=1)
    allowed = F.broadcast(spark.createDataFrame([(n, m, _misses(m, similarity)) for n, m in counts.items()] or [(-1, 0, 0)], "n int, m int, miss int"))
    names = items.select("h", "item_id", "n").distinct()
    names = F.broadcast(names) if names.count() <= SMALL else names

    rows = docs.filter("text IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), _key().alias("dk"), words(F.col("text")).alias("w"))
    sampled = F.when(F.size("w") >= SHINGLE, F.transform(
        F.sequence(F.lit(0), F.size("w") - SHINGLE, F.lit(stride)), lambda i: F.struct(i.alias("at"), _shingle("w", i).alias("h"))))
    hits = rows.select("doc_id", "dk", F.size("w").alias("len"), F.explode(sampled).alias("x")).select("doc_id", "dk", "len", "x.at", "x.h")
    hits = materialize(hits.join(names, "h").select("doc_id", "dk", "len", "item_id", "n", "at").distinct().join(allowed, "n"), "hits")

    first, last = F.greatest(F.lit(0), F.col("at") - F.col("m") + 1), F.least(F.col("at"), F.col("len") - F.col("n"))
    starts = (hits.withColumn("lo", first).withColumn("hi", last).filter("lo <= hi")
              .select("doc_id", "dk", "item_id", "n", "m", "miss", F.explode(F.sequence("lo", "hi")).alias("s")))
    seen = starts.groupBy("dk", "item_id", "s").agg(F.count("*").alias("c"), *[F.first(x).alias(x) for x in ("doc_id", "n", "m", "miss")])
    on_grid = F.floor((F.col("s") + F.col("m") - 1) / stride) - F.ceil(F.col("s") / stride) + 1
    windows = seen.filter(F.col("c") >= on_grid - F.col("miss")).select("dk", "item_id", "s", "n")
    windows = materialize(windows, "windows")

    wanted = windows.select("dk", "s", "n").distinct().groupBy("dk").agg(F.collect_list(F.struct("s", "n")).alias("ws"))
    texts = rows.join(wanted, "dk").dropDuplicates(["dk"]).select("dk", "doc_id", F.explode("ws").alias("x"), "w").select(
        "dk", "doc_id", F.col("x.s").alias("s"), F.col("x.n").alias("n"), F.slice("w", F.col("x.s") + 1, F.col("x.n")).alias("w"))
    shingled = materialize(texts.select("dk", "doc_id", "s", "n", F.explode(
        F.transform(F.sequence(F.lit(0), F.col("n") - SHINGLE), lambda i: _shingle("w", i))).alias("h")), "shingles")
    prints = materialize(_fingerprint(["dk", "s", "n"], shingled, ["doc_id"]), "prints")
    item_prints = _fingerprint(["item_id"], items, ["n"])
    pairs = (_blocks(windows.join(prints, ["dk", "s", "n"])).join(_blocks(item_prints.drop("n")).withColumnRenamed("fp", "ifp"), ["item_id", "block", "part"])
             .filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= RADIUS).select("dk", "doc_id", "s", "n", "item_id").distinct())
    pairs = materialize(pairs, "pairs")
    have = shingled.groupBy("dk", "s", "n", "h").agg(F.count("*").alias("a"))
    want = items.groupBy("item_id", "h").agg(F.count("*").alias("b"))
    common = (pairs.join(have, ["dk", "s", "n"]).join(want, ["item_id", "h"])
              .groupBy("dk", "doc_id", "s", "n", "item_id").agg(F.sum(F.least("a", "b")).alias("common")))
    m = F.col("n") - SHINGLE + 1
    told = common.withColumn("similarity", F.col("common") / (2 * m - F.col("common"))).filter(F.col("similarity") >= similarity - 1e-12)
    best = told.groupBy("dk", "doc_id", "item_id").agg(F.max(F.struct(F.col("similarity"), (-F.col("s")).alias("s"), F.col("n"))).alias("x"))
    short = _short_items(rows, benchmark)
    if short is not None:
        best = best.unionByName(short).groupBy("dk", "doc_id", "item_id").agg(F.max("x").alias("x"))
    best = materialize(best.select("dk", "doc_id", "item_id", (-F.col("x.s")).cast("int").alias("start"), F.col("x.n").cast("int").alias("n_words"),
                                   F.round("x.similarity", 6).alias("similarity")), "leaks")
    for t in (items, hits, windows, shingled, prints, pairs):
        drop_scratch(t)
    return best


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8) -> DataFrame:
    """doc_id, item_id, start, n_words, similarity: the best window of each document and item that reaches the similarity."""
    return _leaks(docs, benchmark, similarity).drop("dk").distinct()


def without_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8) -> DataFrame:
    """``docs`` without the documents that hold an item."""
    bad = _leaks(docs, benchmark, similarity).select(F.col("dk").alias("leaked")).distinct()
    return docs.join(bad, _key() == bad["leaked"], "left_anti")


def op1_simhash_decontamination(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` against all ``benchmark`` items: five-word shingles, similarity 0.8; shorter items word for word."""
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
