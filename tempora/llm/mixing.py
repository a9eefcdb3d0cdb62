"""Mixing sources to target word counts by entropy balancing (DataFrame functions only).

Targets: sources in code-point order, null last, weigh 5, 2, 1, repeating, and share all words; a target stops at ``cap``
times its source's words and the excess is reshared by weight (closed form of the water filling).

Rates: the rates nearest to 1 in relative entropy under one word constraint a source and the bound ``cap`` are exponentially
tilted, ``rate = min(cap, exp(lambda_source * size / mean size))``. The dual is separable and convex; every Newton round is one
distributed aggregate over the (source, size) histogram, kept safe by a bracket. After ``NEWTON_ROUNDS`` rounds every second one
halves the bracket, and rounds go on until each constraint holds or its bracket has no number left inside. Sums are decimals, so
the order in which rows arrive decides nothing. A source whose target is ``cap`` times its words takes every document ``cap`` times.

Copies: ``floor(rate + u + shift)``, u a hash of doc_id, at most ``cap``. The shift is one number a source, found by passes that
evaluate many shifts at once: the largest that doesn't exceed the target. Further stages shift only documents no larger than
the gap that is left, so the words taken end next to the target. Everything depends on the rows alone; reruns agree.

Defined results: null or empty text has size 0 and takes 0; null source is a source of its own, last in order; an empty table
gives no rows; repeated rows get the same rate and copies.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.plans.scratch import materialize

WORD = r"[^\x20\x09-\x0D]+"
NEWTON_ROUNDS, NEWTON_TOLERANCE = 20, 1e-9
PROBES, PROBE_ROUNDS, STAGES = 32, 3, 3


def word_count(text):
    """Number of maximal runs of characters other than ASCII white space (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=(5.0, 2.0, 1.0), cap: float = 3.0) -> DataFrame:
    """source, source_size, target from (source, source_size) rows, one a source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("w", w).withColumn("limit", F.col("source_size") * F.lit(cap)).withColumn("ratio", F.col("limit") / F.col("w"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
                     / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    # in order of ratio, rows before the first whose level fits are capped; that level holds for all from there on
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)
    t = t.withColumn("water", F.coalesce(first["level"], F.lit(float("inf"))))
    return t.select("source", "source_size", F.least(F.col("limit"), F.col("w") * F.col("water")).cast("double").alias("target"))


def _rate(cap: float):
    tilted = F.least(F.lit(cap), F.exp(F.least(F.lit(50.0), F.col("lam") * F.col("x"))))
    return F.when(F.col("full"), F.lit(cap)).otherwise(tilted)


def balance(hist: DataFrame, targets: DataFrame, cap: float = 3.0) -> DataFrame:
    """lambda per source: Newton rounds over the histogram (source, size, n) until each constraint holds."""
    state = targets.select(
        "source", "source_size", "target", (F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)).alias("full"),
        F.lit(0.0).alias("lam"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), F.lit(False).alias("done"))
    means = hist.filter("size > 0").groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    m = means.withColumnRenamed("source", "ms")
    state = state.join(m, state["source"].eqNullSafe(m["ms"]), "left").drop("ms").withColumn("mean", F.coalesce("mean", F.lit(1.0)))
    state = materialize(state, "dual")
    for turn in itertools.count():
        s = state.select(F.col("source").alias("ss"), "lam", "mean", "full")
        terms = (hist.join(s, hist["source"].eqNullSafe(s["ss"])).withColumn("x", F.col("size") / F.col("mean")).withColumn("r", _rate(cap)))
        exact = lambda c: F.sum(c.cast("decimal(38,8)")).cast("double")
        sums = terms.groupBy("source").agg(
            exact(F.col("n") * F.col("size") * F.col("r")).alias("got"),
            exact(F.when(F.col("r") < cap, F.col("n") * F.col("size") * F.col("x") * F.col("r")).otherwise(0.0)).alias("slope"))
        g = sums.withColumnRenamed("source", "gs")
        j = state.join(g, state["source"].eqNullSafe(g["gs"]), "left").drop("gs")
        gap = F.col("got") - F.col("target")
        j = (j.withColumn("done", F.col("full") | F.col("got").isNull() | (F.abs(gap) <= NEWTON_TOLERANCE * F.greatest(F.col("target"), F.lit(1.0))))
             .withColumn("lo", F.when(gap < 0, F.greatest("lo", "lam")).otherwise(F.col("lo")))
             .withColumn("hi", F.when(gap > 0, F.least("hi", "lam")).otherwise(F.col("hi")))
             .withColumn("step", F.col("lam") - gap / F.when(F.col("slope") > 0, F.col("slope"))))
        reach = 2 * F.abs(F.col("lam")) + 1
        low = F.when(F.col("lo") == float("-inf"), F.least(F.col("hi"), F.col("lam")) - reach).otherwise(F.col("lo"))
        high = F.when(F.col("hi") == float("inf"), F.greatest(F.col("lo"), F.col("lam")) + reach).otherwise(F.col("hi"))
        halve = turn >= NEWTON_ROUNDS and turn % 2 == 0
        inside = F.col("step").isNotNull() & (F.col("step") > low) & (F.col("step") < high) & F.lit(not halve)
        j = j.withColumn("next", F.when(inside, F.col("step")).otherwise((low + high) / 2))
        closed = (high - low) <= 4e-16 * F.greatest(F.abs(low), F.abs(high))
        j = j.withColumn("done", F.col("done") | closed).withColumn("lam", F.when(F.col("done"), F.col("lam")).otherwise(F.col("next")))
        state = materialize(j.select(*state.columns), "dual")
        if state.filter(~F.col("done")).isEmpty():
            break
    return state


def _shift(stages: list[tuple[str, str]]):
    """The shift of the last stage whose size bound admits the row; bounds fall from stage to stage."""
    chosen = F.col(stages[0][1])
    for bound, low in stages[1:]:
        chosen = F.when(F.col("size") <= F.col(bound), F.col(low)).otherwise(chosen)
    return chosen


def _copies(shift, cap: int):
    return F.when(F.col("full"), F.lit(cap)).otherwise(F.greatest(F.lit(0), F.least(F.lit(cap), F.floor(F.col("rate") + F.col("u") + shift)))).cast("long")


def _rated(rows: DataFrame, sources: DataFrame, cap: float) -> DataFrame:
    """Rows of (doc_id, source, size, ...) with their source's figures, rate and hash u."""
    s = sources.withColumnRenamed("source", "ss")
    u = F.pmod(F.xxhash64(F.lit("mix"), "doc_id"), F.lit(1 << 52)) / float(1 << 52)
    return (rows.join(s, rows["source"].eqNullSafe(s["ss"])).withColumn("x", F.col("size") / F.col("mean"))
            .withColumn("rate", _rate(cap)).withColumn("u", u).drop("ss", "x"))


def mixing_plan(sizes: DataFrame, weights=(5.0, 2.0, 1.0), cap: int = 3) -> DataFrame:
    """One row a source from (doc_id, source, size): source_size, target, lambda, and the shifts that round rates to copies."""
    hist = materialize(sizes.groupBy("source", "size").agg(F.count("*").alias("n")), "hist")
    totals = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = materialize(source_targets(totals, weights, float(cap)), "targets")
    state = balance(hist, targets, float(cap)).select("source", "source_size", "target", "lam", "mean", "full")
    rated = materialize(_rated(sizes, state, float(cap)).select("source", "size", "rate", "u", "full"), "rated")
    stages: list[tuple[str, str]] = []
    shifts = targets.select("source", "target", F.lit(0.0).alias("gap"))
    for stage in range(STAGES):
        bound, low = f"bound{stage}", f"shift{stage}"
        before = _shift(stages) if stages else F.lit(-1.0)
        shifts = (shifts.withColumn(bound, F.col("gap") if stage else F.lit(float("inf")))
                  .withColumn(low, F.lit(None).cast("double")).withColumn("part", F.lit(1.0)).withColumn("at", F.lit(0.0)))
        for _ in range(PROBE_ROUNDS):
            h = shifts.withColumnRenamed("source", "hs")
            start = F.lit(-1.0) if not stages else F.col(stages[-1][1])
            shift = lambda k: F.when(F.col("size") <= F.col(bound), start + (float(cap) - start) * (F.col("at") + F.col("part") * (k / PROBES))).otherwise(before)  # noqa: B023,E731
            got = (rated.join(h, rated["source"].eqNullSafe(h["hs"])).groupBy("source")
                   .agg(*[F.sum(F.col("size") * _copies(shift(k), cap)).alias(f"g{k}") for k in range(PROBES + 1)]))
            got = got.withColumnRenamed("source", "gs")
            j = shifts.join(got, shifts["source"].eqNullSafe(got["gs"]), "left")
            fits = F.array_max(F.array(*[F.when(F.col(f"g{k}") <= F.col("target"), F.struct(F.lit(k).alias("k"), F.col(f"g{k}").alias("g")))
                                         for k in range(PROBES + 1)]))
            j = (j.withColumn("fit", fits)
                 .withColumn("gap", F.coalesce(F.col("target") - F.col("fit.g"), F.col("gap")))
                 .withColumn("at", F.col("at") + F.col("part") * F.coalesce(F.col("fit.k"), F.lit(0)) / PROBES)
                 .withColumn("part", F.col("part") / PROBES).withColumn(low, start + (float(cap) - start) * F.col("at")))
            shifts = materialize(j.select(*shifts.columns), "shifts")
        stages.append((bound, low))
    h = shifts.withColumnRenamed("source", "hs").select("hs", *[c for s in stages for c in s])
    return materialize(state.join(h, state["source"].eqNullSafe(h["hs"])).drop("hs"), "plan")


def mix_to_targets(docs: DataFrame, weights=(5.0, 2.0, 1.0), cap: int = 3) -> DataFrame:
    """doc_id, size, source, source_size, target, rate, copies, taken for every row of ``docs``."""
    sizes = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                                    word_count(F.col("text")).alias("size")), "sizes")
    rated = _rated(sizes, mixing_plan(sizes, weights, cap), float(cap))
    stages = [(f"bound{k}", f"shift{k}") for k in range(STAGES)]
    return (rated.withColumn("copies", _copies(_shift(stages), cap))
            .select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken")))


def repeated(docs: DataFrame, weights=(5.0, 2.0, 1.0), cap: int = 3) -> DataFrame:
    """The mix itself: each row of ``docs`` as many times as it is copied, with its own columns. Texts are not shuffled."""
    whole = F.struct(*[F.col(c) for c in docs.columns])
    rows = docs.select(whole.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    plan = mixing_plan(materialize(rows.select("doc_id", "source", "size"), "sizes"), weights, cap)
    rated = _rated(rows, plan, float(cap))
    stages = [(f"bound{k}", f"shift{k}") for k in range(STAGES)]
    many = rated.withColumn("copies", _copies(_shift(stages), cap)).filter("copies > 0")
    return many.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def op3_entropy_balanced_mix(spark, sf_dir: str) -> DataFrame:
    """Contract query: the mix of all ``documents``."""
    out = mix_to_targets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
