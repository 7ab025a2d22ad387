"""Bursts of changes in event time, with early flush and release at the end of the source.

A burst is uploaded `delay` after its last change; a flush event (the page is left) uploads an open burst at once. Rows wait
in keyed state until the watermark has passed them and are then taken in time order, so the bursts do not depend on the
order of arrival within the lateness bound. Timers close a burst when its time has come. What is still open when a source
has ended is released by an end marker, a row of the far future that a last run of the same query reads.
"""

from __future__ import annotations

from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..session import shared_dir

RESULT = "user_id BIGINT, burst_us BIGINT, changes BIGINT, item INT, flush_us BIGINT, early BOOLEAN"
COLUMNS = [c.split()[0] for c in RESULT.split(", ")]
END = "_end"
END_TIME = "2250-01-01 00:00:00"


class Bursts(StatefulProcessor):
    """Per user: rows that the watermark has not passed yet, and the open burst."""

    def __init__(self, delay_us: int, flush: str | None):
        self.delay, self.flush = delay_us, flush

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts_us BIGINT, event_id BIGINT, type STRING, item INT")
        self.open = handle.getValueState("open", "burst_us BIGINT, changes BIGINT, last_us BIGINT, item INT")

    def handleInputRows(self, key, rows, timerValues):
        for pdf in rows:
            keep = pdf[pdf["type"] != END]
            if len(keep):
                self.waiting.appendList([
                    (int(t), int(e), None if k is None else str(k), None if pd.isna(i) else int(i))
                    for t, e, k, i in zip(keep["ts_us"], keep["event_id"], keep["type"], keep["item"], strict=True)
                ])
        yield from self.advance(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self.advance(key, timerValues)

    def close(self) -> None:
        pass

    def advance(self, key, timers):
        """Take all rows before the watermark in order; emit the bursts that end before it; set the next timer."""
        mark = timers.getCurrentWatermarkInMs() * 1000
        rows = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        ready = [r for r in rows if r[0] < mark]
        left = rows[len(ready):]
        if ready:
            self.waiting.clear()
            if left:
                self.waiting.put(left)
        burst, out = self.open.get() if self.open.exists() else None, []

        def end(at: int, early: bool) -> None:
            out.append((key[0], burst[0], burst[1], burst[3], at, early))

        for ts, _, kind, item in ready:
            due = burst and burst[2] + self.delay
            if self.flush is not None and kind == self.flush:
                if burst:
                    end(min(ts, due), ts < due)
                burst = None
                continue
            if burst and ts >= due:
                end(due, False)
                burst = None
            burst = (burst[0], burst[1] + 1, ts, item) if burst else (ts, 1, ts, item)
        if burst and burst[2] + self.delay <= mark:
            end(burst[2] + self.delay, False)
            burst = None
        if burst:
            self.open.update(burst)
        elif self.open.exists():
            self.open.clear()
        # one timer a key: when the next row or the open burst is passed
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        nexts = [r[0] for r in left[:1]] + ([burst[2] + self.delay] if burst else [])
        if nexts:
            self.handle.registerTimer(min(nexts) // 1000 + 1)
        if out:
            yield pd.DataFrame(out, columns=COLUMNS).astype({"item": "Int32"})


@contextmanager
def state_store(spark: SparkSession):
    """Keyed state with timers needs the RocksDB store; the session's own setting returns afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def bursts(stream: DataFrame, delay_us: int, lateness: str, flush: str | None = None) -> DataFrame:
    """The bursts of a stream (user_id, ts_us, time, event_id, type, item), each when the watermark has passed its end.

    Rows without a user are no changes of anybody, as in the batch forms.
    """
    rows = stream.filter("user_id is not null").select("user_id", "ts_us", "time", "event_id", "type", "item").withWatermark("time", lateness)
    return rows.groupBy("user_id").transformWithStateInPandas(Bursts(delay_us, flush), RESULT, "append", "eventTime")


def run(stream: DataFrame, delay_us: int, lateness: str, flush: str | None = None, ended: bool = True) -> str:
    """Drain the stream and, if the source has `ended`, release what is open. Returns the folder of bursts.

    Both runs are one query: the second resumes from the first one's checkpoint and meets nothing but the end marker.
    """
    spark = stream.sparkSession
    root = shared_dir(spark, "bursts")
    columns = ["user_id", "ts_us", "time", "event_id", "type", "item"]
    rows = stream.select(*columns)
    nobody = spark.range(1).select(
        *[F.lit(END if c == "type" else END_TIME if c == "time" else 0).cast(rows.schema[c].dataType).alias(c) for c in columns]
    )
    nobody.limit(0).write.parquet(f"{root}/end")
    marks = spark.readStream.schema(nobody.schema).parquet(f"{root}/end")

    def drain() -> None:
        def write(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{root}/data/batch={batch_id}")

        query = bursts(rows.unionByName(marks), delay_us, lateness, flush).writeStream.outputMode("append")
        query = query.option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).foreachBatch(write)
        query.start().awaitTermination()

    with state_store(spark):
        drain()
        if ended:
            nobody.write.mode("append").parquet(f"{root}/end")
            drain()
    return f"{root}/data"
