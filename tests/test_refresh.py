"""Refresh by content id: the index rules files out, replays and interrupted batches add nothing."""

from pathlib import Path

from pyspark.sql import functions as F

from tempora.streaming import refresh

SCHEMA = "k long, name string"


def files(spark, folder, *parts):
    for n, ks in enumerate(parts):
        rows = spark.createDataFrame([(k, f"n{k}" if k % 7 else None) for k in ks], SCHEMA)
        rows.coalesce(1).write.mode("append").parquet(f"{folder}/{n}")
    return f"{folder}/*"


def held(spark, store):
    return sorted(r.k for r in refresh.read_refreshed(spark, store, SCHEMA).collect())


def test_only_files_that_may_hold_ids_are_opened(spark, tmp_path):
    src, store = str(tmp_path / "src"), str(tmp_path / "store")
    spark.createDataFrame([(k, "x") for k in range(4000)], SCHEMA).coalesce(1).write.parquet(src)
    refresh.refresh_by_content(spark, src, SCHEMA, ["k", "name"], store, str(tmp_path / "cp"), 1)
    files_before = spark.read.parquet(f"{store}/rows").select(F.col("_metadata.file_path")).distinct().count()
    assert files_before >= 16
    refresh.merge_batch(spark.createDataFrame([(k, "x") for k in (5, 6, 7)], SCHEMA), "old", ["k", "name"], store)
    refresh.merge_batch(spark.createDataFrame([(k, "new") for k in range(50)], SCHEMA), "new", ["k", "name"], store)
    seen = {r.batch: (r.held, r.opened) for r in refresh.reads(spark, store).collect()}
    where = spark.read.parquet(f"{store}/rows").filter("k in (5, 6, 7) and name = 'x'").select(F.col("_metadata.file_path").alias("f")).distinct().count()
    assert seen["old"] == (files_before, where) and where <= 3  # the files that hold them
    assert seen["new"] == (files_before, 0)  # new rows open none
    assert held(spark, store) == sorted([*range(4000), *range(50)])
    ids = refresh.read_refreshed(spark, store, SCHEMA).filter("k < 300").select("id")
    names = set(refresh.files_that_may_hold(ids, store))
    at = spark.read.parquet(f"{store}/rows").filter("k < 300").select(F.col("_metadata.file_path").alias("f")).distinct()
    assert {r.f for r in at.collect()} <= names  # no file that holds one is missed


def test_replays_repeats_and_interrupted_batches(spark, tmp_path):
    src, store = str(tmp_path / "src"), str(tmp_path / "store")
    where = files(spark, src, range(100), [*range(50, 150), *range(60)], [])
    for cp in ("a", "a", "b"):  # again under the same checkpoint, then under another
        refresh.refresh_by_content(spark, where, SCHEMA, ["k", "name"], store, str(tmp_path / cp), 1)
        assert held(spark, store) == list(range(150))
    more = spark.createDataFrame([(k, "late") for k in (1, 2)], SCHEMA)
    refresh._put(more.withColumn("id", F.sha2("name", 256)).select("id", "k", "name"), store, "cut", ["k", "name"])
    for mark in Path(store, "index", "batch=cut").rglob("*SUCCESS*"):  # as if it had been cut off before its commit
        mark.unlink()
    refresh.merge_batch(more, "cut", ["k", "name"], store)
    assert held(spark, store) == sorted([*range(150), 1, 2])
    refresh.merge_batch(more.limit(1), "cut", ["k", "name"], store)  # committed now
    assert held(spark, store) == sorted([*range(150), 1, 2])
    assert refresh.read_refreshed(spark, store, SCHEMA).select("id").distinct().count() == 152
