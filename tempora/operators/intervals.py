"""Valid-time tables: half-open intervals [f, u) by key, u null where open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.operators.order import running


def islands(rows: DataFrame, key: list[str], t: str = "t") -> DataFrame:
    """Maximal runs of consecutive instants of a key as [f, u). ``rows`` hold each (key, t) once."""
    w = Window.partitionBy(*key).orderBy(t)
    run = rows.withColumn("_run", F.col(t) - F.row_number().over(w))
    return run.groupBy(*key, "_run").agg(F.min(t).alias("f"), (F.max(t) + 1).alias("u")).drop("_run")


def versions_on_change(rows: DataFrame, key: list[str], t: str, value: str) -> DataFrame:
    """One row for each run of equal values in order of ``t``: f its first instant, u the next run's (null for the last)."""
    w = Window.partitionBy(*key).orderBy(t)
    changed = rows.withColumn("_before", F.lag(value).over(w)).filter(F.col("_before").isNull() | (F.col("_before") != F.col(value)))
    return changed.select(*key, value, F.col(t).alias("f")).withColumn("u", F.lead("f").over(Window.partitionBy(*key).orderBy("f")))


def contains(t, f="f", u="u") -> Column:
    """Whether [f, u) holds instant t."""
    t, f, u = (F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x) for x in (t, f, u))
    return (f <= t) & (u.isNull() | (t < u))


def overlaps(f1, u1, f2, u2) -> Column:
    """Whether two half-open intervals share an instant."""
    f1, u1, f2, u2 = (F.col(x) if isinstance(x, str) else x for x in (f1, u1, f2, u2))
    return (u2.isNull() | (f1 < u2)) & (u1.isNull() | (f2 < u1))


def valid_at(table: DataFrame, t: int) -> DataFrame:
    """Rows that stand at one instant: a filter that reaches the scan."""
    return table.filter(contains(t))


def as_of(probes: DataFrame, states: DataFrame, key: list[str], t: str, value: list[str]) -> DataFrame:
    """Each probe with the values of the latest state of its key at or before it (states win ties). One shuffle, no range join."""
    tagged = states.select(*key, t, F.struct(*value).alias("_state"), *[F.lit(None).cast(dict(probes.dtypes)[c]).alias(c) for c in probes.columns if c not in (*key, t)])
    rows = tagged.withColumn("_probe", F.lit(1)).unionByName(
        probes.withColumn("_state", F.lit(None).cast(tagged.schema["_state"].dataType)).withColumn("_probe", F.lit(2)))
    w = Window.partitionBy(*key).orderBy(t, "_probe").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_state", F.last("_state", ignorenulls=True).over(w)).filter("_probe = 2")
    return out.select(*probes.columns, *[F.col(f"_state.{c}").alias(c) for c in value])


def instants_within(instants: DataFrame, table: DataFrame, t: str = "t", bucket: int = 12, last: int | None = None) -> DataFrame:
    """Instants joined to the intervals that hold them: both sides meet on time buckets, the exact test is the residual.

    Open intervals reach to the bucket of ``last`` (the latest instant asked for), so no plan needs a nested loop.
    """
    if last is None:
        last = instants.agg(F.coalesce(F.max(t), F.lit(0)).alias("m")).first().m
    top = F.least(F.coalesce(F.col("u") - 1, F.lit(last)), F.lit(last))
    spread = (table.filter(F.col("f") <= last).withColumn("_b", F.explode(F.sequence(F.floor(F.col("f") / bucket), F.floor(F.greatest(top, F.col("f")) / bucket)))))
    asked = instants.withColumn("_b", F.floor(F.col(t) / bucket))
    return asked.join(spread, "_b").filter(contains(t)).drop("_b")


def census_diff(before: DataFrame, after: DataFrame, key: list[str], body: str) -> DataFrame:
    """Added, Removed and Changed keys between two censuses."""
    a = before.select(*key, F.col(body).alias("was"))
    b = after.select(*key, F.col(body).alias("now"))
    j = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), key, "full")
    tag = (F.when(F.col("_a").isNull(), "Added").when(F.col("_b").isNull(), "Removed").when(~F.col("was").eqNullSafe(F.col("now")), "Changed"))
    return j.withColumn("tag", tag).filter("tag IS NOT NULL").select("tag", *key, "was", "now")


def derive_events(bodies: DataFrame, key: list[str], body: str) -> DataFrame:
    """Rise, Shift and Fall of each key: from rows (key, body, f, u) that don't overlap within a key."""
    w = Window.partitionBy(*key).orderBy("f")
    rows = bodies.withColumn("_u", F.lag("u").over(w)).withColumn("_b", F.lag(body).over(w)).withColumn("_next", F.lead("f").over(w))
    joined = F.col("_u").eqNullSafe(F.col("f"))
    kinds = F.array(
        F.when(~joined, F.struct(F.lit("Rise").alias("kind"), F.col("f").alias("t"))),
        F.when(joined & (F.col("_b") != F.col(body)), F.struct(F.lit("Shift").alias("kind"), F.col("f").alias("t"))),
        F.when(F.col("u").isNotNull() & ~F.col("_next").eqNullSafe(F.col("u")), F.struct(F.lit("Fall").alias("kind"), F.col("u").alias("t"))))
    return rows.select(*key, F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("_ev")).select(*key, "_ev.kind", "_ev.t")


def moments(table: DataFrame, key: list[str]) -> DataFrame:
    """Every interval edge of a key: the instants at which its state may change."""
    edges = table.select(*key, F.col("f").alias("t")).union(table.filter("u IS NOT NULL").select(*key, F.col("u").alias("t")))
    return edges.distinct()


def shadowed(background: DataFrame, owners: DataFrame, key: list[str], t: str) -> DataFrame:
    """Background rows at instants in which no owner of their key stands; spans compare inclusively at both ends."""
    own = owners.select(*[F.col(c).alias(f"_{c}") for c in key], F.col("f").alias("_f"), F.col("u").alias("_u"))
    same = [F.col(c) == F.col(f"_{c}") for c in key]
    hit = (F.col("_f") <= F.col(t)) & (F.col("_u").isNull() | (F.col(t) <= F.col("_u")))
    cond = hit
    for s in same:
        cond = cond & s
    return background.join(own, cond, "left_anti")


def eras(presence: DataFrame) -> DataFrame:
    """f, u, standing, absent: windows between neighbouring span edges, how many stand through each and how many of all don't.

    One row (f, u) a person. A sweep: +1 where a span begins and -1 where it ends, summed over the ordered edges.
    """
    edges = presence.select(F.col("f").alias("t"), F.lit(1).alias("d")).union(presence.select(F.col("u").alias("t"), F.lit(-1).alias("d")))
    steps = running(edges.groupBy("t").agg(F.sum("d").alias("d")), "t", "d", "standing", "u")
    total = presence.agg(F.count("*").alias("total"))  # one row
    return steps.filter("u IS NOT NULL").join(F.broadcast(total)).select(F.col("t").alias("f"), "u", "standing", (F.col("total") - F.col("standing")).alias("absent"))


def absent_spans(presence: DataFrame) -> DataFrame:
    """who, f, u: the spans between the first and the last edge of all in which a person doesn't stand."""
    ends = presence.agg(F.min("f").alias("_lo"), F.max("u").alias("_hi"))  # one row
    rows = presence.join(F.broadcast(ends))
    spans = F.array(F.when(F.col("f") > F.col("_lo"), F.struct(F.col("_lo").alias("f"), F.col("f").alias("u"))),
                    F.when(F.col("u") < F.col("_hi"), F.struct(F.col("u").alias("f"), F.col("_hi").alias("u"))))
    return rows.select("who", F.explode(F.filter(spans, lambda x: x.isNotNull())).alias("s")).select("who", "s.f", "s.u")


def repaired(rows: DataFrame, key: str, order: str, own: str, bound: str) -> DataFrame:
    """``rows`` with date_ and driven: a bound date stays (and drives) only where it is later than the date its predecessor ended up with;
    else, and where there is none, the row's own date stands. The first row of a key keeps its bound date.

    A date depends on the one before only through which of two dates that was. So a row either settles its state whatever came before,
    or passes the state before on, or turns it round; the state is the last settled one, turned as often as rows since say. That takes
    sorted windows and no loop, however long a run of repairs is.
    """
    w = Window.partitionBy(key).orderBy(order)
    seen = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.row_number().over(w) == 1
    own_, bound_ = F.col(own), F.col(bound)
    after_kept = F.coalesce(bound_ > F.lag(F.coalesce(bound_, own_)).over(w), F.lit(False))  # kept if the row before kept its bound date
    after_own = F.coalesce(bound_ > F.lag(own_).over(w), F.lit(False))  # kept if it did not
    told = rows.withColumn("_a", F.when(first, bound_.isNotNull()).otherwise(after_kept)).withColumn("_b", F.when(first, bound_.isNotNull()).otherwise(after_own))
    told = told.withColumn("_turns", F.sum((~F.col("_a") & F.col("_b")).cast("int")).over(seen) % 2 == 1)
    told = told.withColumn("_set", F.last(F.when(F.col("_a") == F.col("_b"), F.col("_a") != F.col("_turns")), ignorenulls=True).over(seen))
    driven = F.col("_set") != F.col("_turns")
    return told.withColumn("driven", driven).withColumn("date_", F.when(driven, bound_).otherwise(own_)).drop("_a", "_b", "_turns", "_set")
