"""Structured Streaming job: change events from observations."""

from __future__ import annotations

import itertools
import json

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CHANGES = "key long, kind string, us long, body string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

PACK = 1000  # rows that wait in one item of the state


def _packed(rows: list) -> list:
    return [(json.dumps(rows[k:k + PACK]),) for k in range(0, len(rows), PACK)]


class Changes(StatefulProcessor):
    """Tells a key's changes in order of event time, however its rows come.

    Rows wait in a list until the watermark has reached them; then no earlier one can come, and they are told in order. The last one told
    stands in a value until its fall. A timer is set for the first row that waits, or else for the fall.

    An item of the list holds up to ``PACK`` rows, as every item and every call on the state costs as much as many rows do.
    """

    def __init__(self, silence_s: float):
        self.silence_ms = round(silence_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "body string, seen long")
        self.waiting = handle.getListState("waiting", "rows string")

    def handleInputRows(self, key, rows, timerValues):
        first = None
        while part := [(r.us, r.event_id, r.body) for r in itertools.islice(rows, PACK)]:
            self.waiting.appendList(_packed(part))
            first = min([r[0] for r in part] + ([] if first is None else [first]))
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((r for (pack,) in self.waiting.get() for r in json.loads(pack)), key=lambda r: (r[0], r[1], r[2] or ""))
        ready = [r for r in rows if r[0] <= now]
        last = self.last.get()
        body, seen = last or (None, None)
        silence, out = self.silence_ms * 1000, []
        for us, _, text in ready:
            if seen is not None and us - seen > silence:
                out.append(("Fall", seen + silence, body))
                seen = None
            if seen is None:
                out.append(("Rise", us, text))
            elif body != text:
                out.append(("Shift", us, text))
            body, seen = text, us
        late = rows[len(ready):]
        if ready:
            self.waiting.put(_packed(late)) if late else self.waiting.clear()
        if seen is not None and seen + silence < now and (not late or late[0][0] - seen > silence):
            out.append(("Fall", seen + silence, body))
            seen = None
        if seen is not None:
            self.last.update((body, seen))
        elif last is not None:
            self.last.clear()
        if late:
            self.handle.registerTimer(-(-late[0][0] // 1000))
        if seen is not None:
            self.handle.registerTimer((seen + silence) // 1000 + 1)
        return iter([Row(key=key[0], kind=kind, us=us, body=body) for kind, us, body in out])

    def close(self) -> None:
        pass


def change_stream(observations: DataFrame, silence_s: float, lateness: str = "1 hour") -> DataFrame:
    """Rise, Shift and Fall of each key from a stream of (key, ts, event_id, body).

    A change is told when the watermark has passed it, a Fall (dated ``silence_s`` after the last observation) when it has passed that
    date, at which the key's state goes. So the same rows come out however rows up to ``lateness`` late are cut into batches; later ones
    are dropped. Rows that the watermark hasn't reached wait: a closed input is told to its end by a last row that is ``lateness`` later.
    Rows without a key are left out. The session's state store becomes RocksDB, which the buffers need.
    """
    observations.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = observations.withWatermark("ts", lateness).filter("key IS NOT NULL").select("key", "ts", F.unix_micros("ts").alias("us"), F.coalesce("event_id", F.lit(-1)).alias("event_id"), "body")
    told = rows.groupBy("key").transformWithState(Changes(silence_s), CHANGES, "Append", "EventTime")
    return told.select("key", "kind", F.timestamp_micros("us").alias("at"), "body")


def run_to_end(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Process what is there and stop."""
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
