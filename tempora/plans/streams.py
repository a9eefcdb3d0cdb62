"""Streaming queries run to the end of their input."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.plans.catalog import query
from tempora.plans.files import fresh
from tempora.sources.tables import table
from tempora.streaming.changes import change_stream, run_to_end
from tempora.streaming.refresh import read_refreshed, refresh_by_content

SILENCE = 5 * 86400
NOBODY = -(2**63)


@query("R1_change_stream", f"""WITH o AS (SELECT user_id AS key_, ts, event_type body, lag(ts) OVER w pt, lag(event_type) OVER w pb FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
  SELECT key_, 'Rise' AS kind, body, epoch_us(ts) // 1000000 AS at_ FROM o WHERE pt IS NULL OR epoch_us(ts) - epoch_us(pt) > {SILENCE}000000
  UNION ALL SELECT key_, 'Fall', pb, epoch_us(pt) // 1000000 + {SILENCE} FROM o WHERE epoch_us(ts) - epoch_us(pt) > {SILENCE}000000
  UNION ALL SELECT user_id, 'Fall', arg_max(event_type, (ts, event_id)), epoch_us(max(ts)) // 1000000 + {SILENCE} FROM events GROUP BY 1 HAVING epoch_us(max(ts)) + {SILENCE}000000 < (SELECT epoch_ms(max(ts)) * 1000 + 1000000 FROM events)
  UNION ALL SELECT key_, 'Shift', body, epoch_us(ts) // 1000000 FROM o WHERE epoch_us(ts) - epoch_us(pt) <= {SILENCE}000000 AND pb <> body""")
def r1(spark, sf):
    src, out, cp = (fresh(spark, n) for n in ("observations", "changes", "offsets"))
    rows = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("event_type").alias("body"))
    # the last row, under a key of its own, closes the input: an hour and a second after all others, so that the watermark passes them
    end = rows.agg((F.max("ts") + F.expr("interval 3601 seconds")).alias("ts")).select(F.lit(NOBODY).cast("long").alias("key"), "ts", F.lit(-1).cast("long").alias("event_id"), F.lit("end").alias("body"))
    rows.unionByName(end).write.parquet(src)
    stream = spark.readStream.schema("key long, ts timestamp, event_id long, body string").parquet(src)
    run_to_end(change_stream(stream, SILENCE), out, cp)
    rows = spark.read.schema("key long, kind string, at timestamp, body string").parquet(out).filter(F.col("key") != NOBODY)
    return rows.select(F.col("key").alias("key_"), "kind", "body", F.floor(F.unix_micros("at") / 1000000).alias("at_"))


@query("R2_refresh_by_content", "SELECT o_custkey, o_orderstatus, o_orderpriority FROM orders GROUP BY 1, 2, 3")
def r2(spark, sf):
    src, out, cp = (fresh(spark, n) for n in ("sources", "store", "offsets"))
    o = table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority")
    o.union(o).repartition(8).write.parquet(src)  # the same rows arrive twice
    schema = "o_custkey long, o_orderstatus string, o_orderpriority string"
    refresh_by_content(spark, src, schema, o.columns, out, cp)
    return read_refreshed(spark, out, schema).select(*o.columns)
