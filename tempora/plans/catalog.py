"""Registration of queries beside the SQL they are checked against."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


ESTIMATED, MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
FIRST, ADVISED = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
BEFORE = "tempora.joins.before"  # what the session had
SHARE = 2 << 20  # bytes of the tables' files for each partition that a shuffle begins with
MOST = 200  # partitions that a shuffle begins with; beyond Spark's bypass threshold a map task would sort all its rows in memory
ADVICE = "4m"  # shuffled bytes of a task; sorted or hashed they take many times as much memory


def _stored(spark: SparkSession, sf_dir: str) -> int:
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getContentSummary(path).getLength()


def by_measured_size(fn):
    """``fn`` in a session whose joins broadcast a side by its size once shuffled, not by an estimate.

    The estimate is the size of the files: it knows nothing of rows that an explode makes, and files of regular numbers are a small part
    of their rows, so a side of millions of rows would be gathered in the driver. Hints stand.

    Shuffles begin with as many partitions as the tables' size asks for, ``MOST`` at most, and are merged up to ``ADVICE``: with a few
    partitions at every size a task's memory would grow with the tables.
    """

    @functools.wraps(fn)
    def run(spark, sf_dir):
        if spark.conf.get(BEFORE, None) is None:
            had = {ESTIMATED: spark.conf.get(ESTIMATED), **{c: spark.conf.get(c, None) for c in (MEASURED, FIRST, ADVISED)}}
            spark.conf.set(BEFORE, json.dumps(had))
            if had[ESTIMATED] != "-1":
                spark.conf.set(MEASURED, had[MEASURED] or had[ESTIMATED])
                spark.conf.set(ESTIMATED, "-1")
            spark.conf.set(ADVISED, ADVICE)
        spark.conf.set(FIRST, str(max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST, -(-_stored(spark, sf_dir) // SHARE)))))
        return fn(spark, sf_dir)

    return run


def by_own_rule(spark) -> None:
    """Give a session that :func:`by_measured_size` changed its own rule back."""
    before = spark.conf.get(BEFORE, None)
    if before:
        for name, value in json.loads(before).items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
        spark.conf.unset(BEFORE)


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``."""

    def put(fn):
        if name in QUERIES:
            raise ValueError(f"two queries are called {name}")
        QUERIES[name] = by_measured_size(fn)
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return put
