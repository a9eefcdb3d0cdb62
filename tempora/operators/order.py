"""Order-dependent columns over a whole table without a task that holds it: range partitions, then prefix sums of their totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.plans.scratch import materialize


def _ranged(rows: DataFrame, order: list) -> DataFrame:
    """Rows with their range partition ``_part``; written, so that every reader sees the same cut."""
    return materialize(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """``rows`` with their place (from 1) in a total order."""
    placed = _ranged(rows, order)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a partition
    offsets = placed.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.withColumn("_own", own).join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_part", "_own", "_before")


def running(rows: DataFrame, at: str, value: str, total: str, after: str) -> DataFrame:
    """``rows`` (one for each ``at``) with the sum of ``value`` up to and with each, and the next ``at`` (null for the last)."""
    placed = _ranged(rows, [at])
    w = Window.orderBy("_part")  # over one row a partition
    parts = placed.groupBy("_part").agg(F.sum(value).alias("_s"), F.min(at).alias("_first"))
    parts = parts.select("_part", F.coalesce(F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.lead("_first").over(w).alias("_next"))
    own = Window.partitionBy("_part").orderBy(at)
    out = placed.withColumn("_sum", F.sum(value).over(own)).withColumn("_lead", F.lead(at).over(own)).join(F.broadcast(parts), "_part")
    return out.withColumn(total, F.col("_sum") + F.col("_before")).withColumn(after, F.coalesce("_lead", "_next")).drop("_part", "_sum", "_lead", "_before", "_next")
