"""The content-addressed store: Parquet tables by layer, every row under an id that is recomputed when it is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions.names import content_id

FIELDS = ["layer", "e", "name", "f", "u"]


def with_id(rows: DataFrame) -> DataFrame:
    return rows.select(content_id(*[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in FIELDS]).alias("id"), *FIELDS)


def write_store(rows: DataFrame, path: str) -> None:
    """One folder a layer, rows once each, in the order of their ids within files; a large layer is written by many tasks."""
    spread = with_id(rows).dropDuplicates(["id"]).repartition("layer", F.substring("id", 1, 3))
    spread.sortWithinPartitions("layer", "id").write.partitionBy("layer").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, e long, name string, f long, u long, layer string").parquet(path)


def forged(stored: DataFrame) -> DataFrame:
    """Rows whose id isn't that of their content; lawful stores have none."""
    again = content_id(*[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in FIELDS])
    return stored.filter(F.col("id") != again)


def verified_store(spark: SparkSession, path: str) -> DataFrame:
    """The store's rows; a row under a false id stops the read."""
    rows = read_store(spark, path)
    again = content_id(*[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in FIELDS])
    return rows.withColumn("id", F.when(F.col("id") == again, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("false id "), F.col("id")))))
