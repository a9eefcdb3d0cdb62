"""Near-duplicate documents by an LSH forest over MinHash signatures.

1. Every document's set of word shingles gets ``VALUES`` MinHash values and a 192-bit identity; equal sets become one class
   with its smallest doc_id, so groups of copies cost one row. Classes have numbers of their own (``rep``).
2. The forest: ``TREES`` sorted orders of the signatures, each a rotation of the values. Rows that agree on the first ``DEPTH``
   values of an order form a region. A larger region is cut by more values (adaptive depth, and by row where even those agree),
   and inside a cut each row's candidates are its neighbours in sorted order, those with the longest common prefix.
3. Candidates are confirmed on full sets (intersection and union counts). The best candidates come first; others only where they
   still join two components.
4. Where a region holds several components after that, every row outside its largest component meets every row of the region, in
   blocks that work on full sets and emit at most one link for each component. So all links inside a region take effect, however
   large it is, without listing its pairs.

A pair of similarity s shares no region with probability (1 - s^DEPTH)^TREES: 7e-6 at 0.85, 2e-4 at 0.8.

Defined results: null or wordless text has the empty set and links with nothing; fewer words than the shingle width make one
shingle; a null doc_id is its own row with a null component; repeated rows share class and component; rows of one doc_id with
different texts are compared by their texts, each in its own group; other columns are ignored. Texts of any length are worked in
pieces of bounded size. Shingles are compared as 52-bit hashes of their words' bytes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm.words import mix, runs, shingle_sets, slices, small_batches, utf8
from tempora.operators.graph import connected_components
from tempora.plans.scratch import drop_scratch, materialize

TREES, DEPTH = 16, 4
VALUES = TREES * DEPTH
NEIGHBOURS = 3  # next rows in sorted order that are candidates
CUT = 32  # rows of a region that need no deeper cut
OUTER, ROWS = 1 << 16, 1 << 18  # shingles that a block of outer rows and one of region rows hold on average
_U = np.uint64
_rng = np.random.default_rng(8)
_MULT = _rng.integers(0, 2**64, VALUES, dtype=_U) | _U(1)
_ADD = _rng.integers(0, 2**64, VALUES, dtype=_U)


def _identity(key: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    return np.add.reduceat(mix(key * _MULT[k] + _ADD[k + 3]), at).view(np.int64)


def _signed(docs: DataFrame, width: int, tag) -> DataFrame:
    """doc_id, tag, n, s1, s2, s3 (identity of the set) and sig (VALUES big-endian 32-bit values) of every document."""

    def run(batches):
        for b in batches:
            offsets, data = utf8(b.column("text"))
            for i, j in slices(offsets):
                doc, key = shingle_sets(offsets[i:j + 1] - offsets[i], data[offsets[i]:offsets[j]], width)
                at, rows = runs(doc), j - i
                n = np.bincount(doc, minlength=rows).astype(np.int64)
                full = np.flatnonzero(n)
                ident = np.zeros((3, rows), np.int64)
                sig = np.zeros((rows, VALUES), ">u4")
                if len(at):
                    for k in range(3):
                        ident[k, full] = _identity(key, at, k)
                    for k in range(VALUES):
                        sig[full, k] = np.minimum.reduceat(((key * _MULT[k] + _ADD[k]) >> _U(32)).astype(np.uint32), at)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, rows), b.column("tag").slice(i, rows), pa.array(n), *(pa.array(x) for x in ident),
                     pa.array([x.tobytes() for x in sig], pa.binary())], ["doc_id", "tag", "n", "s1", "s2", "s3", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), tag.alias("tag"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, tag long, n long, s1 long, s2 long, s3 long, sig binary")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """rep, shingles (sorted distinct hashes) from (rep, s1, text): of those texts whose set is the class's."""

    def run(batches):
        for b in batches:
            offsets, data = utf8(b.column("text"))
            s1 = b.column("s1").to_numpy()
            for i, j in slices(offsets):
                doc, key = shingle_sets(offsets[i:j + 1] - offsets[i], data[offsets[i]:offsets[j]], width)
                ends = np.searchsorted(doc, np.arange(j - i + 1))
                got = np.zeros(j - i, np.int64)
                if len(doc):
                    got[doc[runs(doc)]] = _identity(key, runs(doc), 0)
                lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(key.view(np.int64))).cast(pa.list_(pa.int64()))
                out = pa.RecordBatch.from_arrays([b.column("rep").slice(i, j - i), lists], ["rep", "shingles"])
                yield out.filter(pa.array(got == s1[i:j]))

    return docs.select("rep", "s1", "text").mapInArrow(run, "rep long, shingles array<bigint>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""
    a = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (pairs.select("a", "b").join(a, "a").join(b, "b")
            .withColumn("common", both).filter(100 * F.col("common") >= percent * (F.size("sa") + F.size("sb") - F.col("common")))
            .select("a", "b"))


def _block(percent: int):
    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links between the outer rows of a region's block and the block's other rows, one for each pair of components."""
        outer, rows = pdf[pdf["outer"]], pdf[~pdf["outer"]]
        sizes = rows["shingles"].map(len).to_numpy()
        out_a, out_b = [], []
        if len(rows) and len(outer):
            owner = np.repeat(np.arange(len(rows)), sizes)
            flat = np.concatenate(rows["shingles"].to_list())
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            comp, rep = rows["component"].to_numpy(), rows["rep"].to_numpy()
            for r, c, s in zip(outer["rep"], outer["component"], outer["shingles"], strict=True):
                lo, hi = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
                n = hi - lo
                at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                common = np.bincount(owner[at], minlength=len(rows))
                good = np.flatnonzero((100 * common >= percent * (sizes + len(s) - common)) & (comp != c))
                for k in good[np.unique(comp[good], return_index=True)[1]]:
                    out_a.append(min(r, rep[k]))
                    out_b.append(max(r, rep[k]))
        return pd.DataFrame({"a": np.array(out_a, np.int64), "b": np.array(out_b, np.int64)})

    return links


def _labelled(df: DataFrame, components: DataFrame, key: str, name: str) -> DataFrame:
    c = components.select(F.col("id").alias(key), F.col("component").alias(name))
    return df.join(c, key, "left").withColumn(name, F.coalesce(name, key))


def _grouped(docs: DataFrame, width: int, percent: int, tag) -> DataFrame:
    """doc_id, tag, n, grp (number of the row's component; null without shingles or doc_id), component_id of every row of ``docs``."""
    small_batches(docs.sparkSession)
    signed = materialize(_signed(docs, width, tag), "signed")
    ident = ["n", "s1", "s2", "s3"]
    classes = materialize(signed.filter("n > 0 AND doc_id IS NOT NULL").groupBy(*ident).agg(
        F.min("doc_id").alias("doc"), F.first("sig").alias("sig")).withColumn("rep", F.monotonically_increasing_id()), "classes")

    # the forest's regions: rows that agree on the first DEPTH values of an order
    trees = classes.select("rep", F.posexplode(F.array(*[
        F.xxhash64(F.lit(t), F.substring(F.col("sig"), 4 * DEPTH * t + 1, 4 * DEPTH)) for t in range(TREES)])).alias("t", "k"))
    regions = trees.groupBy("k").agg(F.count("*").alias("m")).filter("m > 1")
    members = materialize(trees.join(regions.select("k", "m"), "k"), "members")
    sig = classes.select("rep", "sig")
    deeper = f"cast(4 * least(12, ceil(log2(m / {CUT}.0))) as int)"  # bytes of values beyond DEPTH that cut a large region
    sorted_rows = (members.join(sig, "rep")
                   .withColumn("tail", F.expr(f"substring(concat(sig, sig), {4 * DEPTH} * (t + 1) + 1, 64)"))
                   .withColumn("cut", F.when(F.col("m") > CUT, F.xxhash64(F.expr(f"substring(tail, 1, {deeper})"),
                                                                          F.pmod(F.xxhash64("rep"), F.ceil(F.col("m") / 512)))))
                   .select("k", "cut", "tail", "rep", "sig"))
    order = Window.partitionBy("k", "cut").orderBy("tail", "rep")
    ahead = sorted_rows.select("rep", "sig", *[F.lead(F.struct(F.col("rep").alias("rep"), F.col("sig").alias("sig")), i).over(order).alias(f"p{i}")
                                               for i in range(1, NEIGHBOURS + 1)])
    near = ahead.select("rep", "sig", F.explode(F.array(*[F.col(f"p{i}") for i in range(1, NEIGHBOURS + 1)])).alias("p")).filter("p IS NOT NULL")
    agree = F.expr("size(filter(sequence(0, %d), i -> substring(sig, 4 * i + 1, 4) = substring(p.sig, 4 * i + 1, 4)))" % (VALUES - 1))
    floor = int(VALUES * (percent / 100 - 5 * (percent / 100 * (1 - percent / 100) / VALUES) ** 0.5))  # five deviations below
    pairs = (near.select(F.least("rep", "p.rep").alias("a"), F.greatest("rep", "p.rep").alias("b"), agree.alias("agree"))
             .filter(F.col("agree") >= floor).distinct())
    pairs = materialize(pairs, "pairs")

    # full sets of the rows that have a candidate or share a region too large for the neighbours to cover
    wide = members.filter(F.col("m") > NEIGHBOURS + 1).select("rep")
    wanted = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).union(wide).distinct()
    wanted = classes.select("rep", "doc", "n", "s1").join(wanted, "rep")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")).join(wanted.select("rep", "doc", "s1"), "doc")
    sets = materialize(_sets(texts, width).dropDuplicates(["rep"]), "sets")

    both_ways = pairs.select("a", "b", "agree").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "agree"))
    best = both_ways.groupBy("a").agg(F.max(F.struct("agree", F.col("b"))).alias("x")).select(
        F.least("a", "x.b").alias("a"), F.greatest("a", "x.b").alias("b")).distinct()
    first_links = materialize(_confirmed(best, sets, percent), "links")
    components = connected_components(first_links)
    open_pairs = _labelled(_labelled(pairs, components, "a", "ca"), components, "b", "cb").filter("ca <> cb")
    more_links = materialize(_confirmed(open_pairs.join(best, ["a", "b"], "left_anti"), sets, percent), "links")
    links = first_links.unionByName(more_links)
    components = connected_components(links)

    # completion of regions with more rows than the neighbours cover and more than one component
    region_rows = _labelled(members.filter(F.col("m") > NEIGHBOURS + 1), components, "rep", "component").join(classes.select("rep", "n"), "rep")
    region_rows = materialize(region_rows, "rows")
    per = region_rows.groupBy("k", "component").agg(F.count("*").alias("c"), F.sum("n").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("s"))
    main = per.groupBy("k").agg(F.max(F.struct("n", "component")).alias("main"), F.count("*").alias("parts"), F.sum("c").alias("m"),
                                F.sum("n").alias("n"), F.bit_xor("s").alias("s")).filter("parts > 1")
    main = main.groupBy("m", "n", "s", "main").agg(F.min("k").alias("k"))  # the same rows in another order
    mixed = region_rows.drop("n").join(main.select("k", "main", "n"), "k").join(sets, "rep")
    outer_blocks, chunks = F.ceil((F.col("n") - F.col("main.n")) / OUTER).cast("int"), F.ceil(F.col("n") / ROWS).cast("int")
    slot = lambda name, parts: F.pmod(F.xxhash64(F.lit(name), "rep"), parts).cast("int")
    cols = ["k", "rep", "component", "shingles"]
    as_outer = (mixed.filter("component <> main.component").withColumn("o", slot("o", outer_blocks))
                .withColumn("c", F.explode(F.sequence(F.lit(0), chunks - 1))).select(*cols, "o", "c", F.lit(True).alias("outer")))
    as_row = (mixed.withColumn("c", slot("c", chunks)).withColumn("o", F.explode(F.sequence(F.lit(0), outer_blocks - 1)))
              .select(*cols, "o", "c", F.lit(False).alias("outer")))
    found = as_outer.unionByName(as_row).groupBy("k", "o", "c").applyInPandas(_block(percent), "a long, b long")
    found = materialize(found.distinct(), "links")
    components = connected_components(links.unionByName(found))

    labelled = _labelled(classes.select(*ident, "rep", "doc"), components, "rep", "grp")
    least = labelled.groupBy("grp").agg(F.min("doc").alias("component_id"))
    out = signed.drop("sig").join(labelled.select(*ident, "grp").join(least, "grp"), ident, "left")
    known = F.col("doc_id").isNotNull()
    out = materialize(out.select("doc_id", "tag", "n", F.when(known, F.col("grp")).alias("grp"),
                                 F.when(known, F.coalesce("component_id", "doc_id")).alias("component_id")), "grouped")
    for t in (signed, classes, members, pairs, sets, first_links, more_links, region_rows, found):
        drop_scratch(t)
    return out


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``; linked where 100 x common >= percent x union."""
    out = _grouped(docs, width, percent, F.lit(0).cast("long"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of smallest doc_id, and of those the one of least hash.

    Rows that repeat in all columns stay once; rows without words or without a doc_id stay.
    """
    name = "_row"
    while name in docs.columns:
        name += "_"
    rows = _grouped(docs, width, percent, F.xxhash64(*docs.columns))
    grouped = rows.filter("grp IS NOT NULL")
    first = grouped.groupBy("grp").agg(F.min(F.struct("doc_id", "tag")).alias("first"))
    gone = grouped.join(first, "grp").filter("struct(doc_id, tag) <> first").select(F.col("doc_id").alias("_d"), F.col("tag").alias("_t")).distinct()
    keyed = docs.filter("doc_id IS NOT NULL").withColumn(name, F.xxhash64(*docs.columns))
    stay = keyed.join(gone, (F.col("doc_id").cast("long") == F.col("_d")) & (F.col(name) == F.col("_t")), "left_anti").dropDuplicates(["doc_id", name])
    return stay.drop(name).unionByName(docs.filter("doc_id IS NULL"))


def op8_lsh_forest_near_dups(spark, sf_dir: str) -> DataFrame:
    """Contract query: all ``documents``, three-word shingles, 85 percent."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, percent=85)
