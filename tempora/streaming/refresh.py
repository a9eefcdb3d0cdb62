"""Incremental refresh of a store by content id, with an index that tells which of the store's files a batch has to open.

The store is three tables in one folder. ``rows`` holds a folder a batch and, in it, one an id prefix; ``index`` holds for each of these
files the words of a Bloom filter that are not zero; ``reads`` says for each batch how many files the store had and how many were opened.
An id picks a prefix (its first digit), a word (four digits) and three bits of it; the digits for word and bits stand so far back that
they are even within a file, whose ids are a range. So the filter is built by one aggregation and asked by one equality join on
(prefix, word), and all of that stays in DataFrame functions.

A batch is committed when its index is written. One that is cut off before is done again under the same name from the same files, and
its half-written rows are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions.names import content_id
from tempora.plans.scratch import drop_scratch, materialize

PREFIX, WORD, WORD_AT = 1, 4, 33  # digits of an id: folders, words of a filter and where those begin
ROWS_A_FILE = 500_000  # at most eight ids a word, at which three bits of another id are all set in three of a hundred files
INDEX = "word int, file string, bits long, batch string, prefix string"
READS = "held long, opened long, batch string"


def _digits(first: int, n: int):
    return F.conv(F.substring("id", first, n), 16, 10).cast("int")


def _filter_place() -> list:
    """prefix, word and mask (three of 64 bits) of ``id``."""
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), _digits(WORD_AT + WORD + 2 * k, 2) % 64)
    mask = bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2))
    return [F.substring("id", 1, PREFIX).alias("prefix"), _digits(WORD_AT, WORD).alias("word"), mask.alias("mask")]


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def files_that_may_hold(ids: DataFrame, store: str) -> list[str]:
    """Names of the store's files whose filters don't rule out all of ``ids`` (id)."""
    spark = ids.sparkSession
    if not _there(spark, f"{store}/index"):
        return []
    asked = ids.select(*_filter_place()).distinct()
    index = spark.read.schema(INDEX).option("basePath", f"{store}/index").parquet(f"{store}/index")
    hit = asked.join(index, ["prefix", "word"]).filter(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
    return [r.file for r in hit.select("file").distinct().collect()]  # names of files, of which the driver lists all it reads anyway


def _put(rows: DataFrame, store: str, name: str, fields: list[str]) -> None:
    """Rows first, then the index that commits them."""
    spark = rows.sparkSession
    place = f"{store}/rows/batch={name}"
    spread = rows.withColumn("prefix", F.substring("id", 1, PREFIX)).repartitionByRange("id").sortWithinPartitions("prefix", "id")
    spread.write.mode("overwrite").option("maxRecordsPerFile", ROWS_A_FILE).partitionBy("prefix").parquet(place)
    kept = spark.read.schema(rows.select("id", *fields).schema).parquet(place).select("id", F.col("_metadata.file_path").alias("file"))
    words = kept.select("file", *_filter_place()).groupBy("prefix", "word", "file").agg(F.bit_or("mask").alias("bits"))
    words.repartitionByRange("prefix", "file").sortWithinPartitions("prefix", "file", "word").write.mode("overwrite").partitionBy("prefix").parquet(f"{store}/index/batch={name}")


def merge_batch(batch: DataFrame, name: str, fields: list[str], store: str) -> None:
    """Add the rows of ``batch`` that the store doesn't hold. ``name`` is the batch's own; one that was committed is passed over.

    The id is the sha256 of the fields, nulls written as ``-``; of rows with one id one is kept.
    """
    spark = batch.sparkSession
    if _there(spark, f"{store}/index/batch={name}/_SUCCESS"):
        return
    rows = batch.select(*fields).withColumn("id", content_id(*[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in fields])).dropDuplicates(["id"])
    rows = materialize(rows.select("id", *fields), "batch")
    names = files_that_may_hold(rows.select("id"), store)
    held = spark.read.schema(INDEX).option("basePath", f"{store}/index").parquet(f"{store}/index").select("file").distinct().count() if _there(spark, f"{store}/index") else 0
    new = rows
    if names:
        known = spark.read.schema("id string").parquet(*names)
        new = rows.join(known, "id", "left_anti")
    _put(new, store, name, fields)
    spark.range(1).select(F.lit(held).cast("long").alias("held"), F.lit(len(names)).cast("long").alias("opened")).coalesce(1).write.mode("overwrite").parquet(f"{store}/reads/batch={name}")
    drop_scratch(rows)


def refresh_by_content(spark: SparkSession, source: str, schema: str, fields: list[str], store: str, checkpoint: str, files_a_batch: int = 4) -> None:
    """Append to ``store`` the rows of new source files whose content id it doesn't hold; replays, under any checkpoint, add nothing."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    run: list[str] = []

    def merge(batch: DataFrame, epoch: int) -> None:
        if not run:  # the query's own name outlives its restarts and differs between checkpoints
            run.append(batch.sparkSession.read.schema("id string").json(f"{checkpoint}/metadata").first().id)
        merge_batch(batch, f"{run[0]}-{epoch:010d}", fields, store)

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_refreshed(spark: SparkSession, store: str, schema: str) -> DataFrame:
    """The store's rows: id and the fields of ``schema``."""
    rows = spark.read.schema(f"id string, {schema}, batch string, prefix string").option("basePath", f"{store}/rows").parquet(f"{store}/rows")
    return rows.drop("batch", "prefix")


def reads(spark: SparkSession, store: str) -> DataFrame:
    """held, opened, batch: files that the store had before each batch, and those that the batch opened."""
    return spark.read.schema(READS).option("basePath", f"{store}/reads").parquet(f"{store}/reads")
