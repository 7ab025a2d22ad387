"""Structured Streaming forms of the event-time behaviour.

Every job runs `availableNow` over the files present and writes through `foreachBatch` into one
folder per batch, overwritten when a batch is replayed; nothing passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge as M
from ..operators import schedule as N
from ..session import materialize, shared_dir
from ..sources import adapters as A


def event_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet", max_files: int = 64) -> DataFrame:
    """The events as a stream with the instant as a zoned timestamp (watermarks need one).

    `max_files` bounds a micro-batch, and with it what one key can bring into one task.
    """
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", max_files)
    raw = reader.parquet(folder)
    return raw.select(
        "event_id",
        "user_id",
        A.micros("ts").alias("ts_us"),
        F.timestamp_micros(A.micros("ts")).alias("time"),
        F.get_json_object("props", "$.k").cast("int").alias("item"),
        F.col("event_type").alias("type"),
        "value",
    )


def run_to_folder(stream: DataFrame, name: str, mode: str, prepare=None) -> str:
    """Drain the stream; each batch goes to its own folder, so a replayed batch replaces itself."""
    root = shared_dir(stream.sparkSession, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        out = batch if prepare is None else prepare(batch)
        out.write.mode("overwrite").parquet(f"{root}/data/batch={batch_id}")

    (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{root}/progress")
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
        .awaitTermination()
    )
    return f"{root}/data"


def debounce(stream: DataFrame, delay: str, lateness: str) -> DataFrame:
    """Closed bursts of changes as session windows; the window's end is the upload time."""
    w = stream.withWatermark("time", lateness).groupBy("user_id", F.session_window("time", delay).alias("w"))
    out = w.agg(F.count("*").alias("changes"), F.max_by("item", F.struct("ts_us", "event_id")).alias("item"))
    return out.select(
        "user_id",
        F.unix_micros("w.start").alias("burst_us"),
        F.unix_micros("w.end").alias("flush_us"),
        "changes",
        "item",
    )


def exactly_once(stream: DataFrame, keys: list[str], lateness: str) -> DataFrame:
    """Drop repeats of a record that arrive within the lateness bound."""
    return stream.withWatermark("time", lateness).dropDuplicatesWithinWatermark(keys)


def event_outcomes(stream: DataFrame) -> DataFrame:
    """Outcomes (user_id, item, t, seq, q) of the event stream."""
    q = (F.floor("value") % 6).cast("int")
    t = F.floor(F.col("ts_us") / 1000).cast("bigint")
    return stream.select("user_id", "item", t.alias("t"), F.col("event_id").alias("seq"), q.alias("q"))


BUCKETS = 64


def running_schedules(outcomes: DataFrame, keys: list[str], name: str = "schedules") -> str:
    """Item schedules kept up to date by a stream of outcomes (keys, t, seq, q), whatever the order they arrive in.

    Every batch adds its outcomes to a history and the schedules it changes as new versions. A key whose outcomes all
    follow what it has seen goes on from its stored state. A key with an earlier one is marked, and only marked keys are
    folded again from their history, of which only their buckets are read. Returns the folder of versions, the latest
    batch of a key being its schedule; a replayed batch replaces its own files and reads only earlier ones.
    """
    spark = outcomes.sparkSession
    root = shared_dir(spark, name)
    history, versions = f"{root}/history", f"{root}/versions"
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
    last = F.max(F.struct("t", "seq")).alias("_last")

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(*keys, "t", "seq", "q", bucket.alias("bucket"))
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{history}/batch={batch_id}")
        new = spark.read.schema(rows.schema).option("basePath", history).parquet(f"{history}/batch={batch_id}").select(*rows.columns)
        met = new.groupBy(*keys).agg(F.min(F.struct("t", "seq")).alias("_first"), last, F.count("*").alias("_n"))
        stored = None
        if batch_id:
            old = spark.read.parquet(versions).filter(F.col("batch") < batch_id)
            stored = latest_versions(spark, old, keys, "batch_no")
            met = met.join(stored.select(*keys, F.struct("last_t", "last_seq").alias("_seen"), "reviews"), keys, "left")
        else:
            met = met.withColumn("_seen", F.lit(None).cast("struct<last_t:bigint,last_seq:bigint>")).withColumn("reviews", F.lit(None).cast("bigint"))
        late = F.coalesce(F.struct(F.col("_first.t").alias("last_t"), F.col("_first.seq").alias("last_seq")) < F.col("_seen"), F.lit(False))
        met = materialize(met.withColumn("_late", late).withColumn("bucket", bucket), "met")
        on_time = new.join(met.filter("not _late").select(*keys), keys, "left_semi")
        empty = spark.createDataFrame([], met.select(*keys).schema)
        for c, kind in (("repetitions", "bigint"), ("interval_days", "double"), ("ease_factor", "double"), ("due_at", "bigint"), ("last_reviewed_at", "bigint")):
            empty = empty.withColumn(c, F.lit(None).cast(kind))
        before = empty if stored is None else stored.join(met.filter("not _late").select(*keys), keys, "left_semi")
        done = N.apply_outcomes(before, on_time.select(*keys, "t", "seq", "q"), keys).select(*keys, *N.STATE)
        buckets = [r.bucket for r in met.filter("_late").select("bucket").distinct().collect()]  # at most BUCKETS
        if buckets:
            past = spark.read.parquet(history).filter(F.col("bucket").isin(buckets) & (F.col("batch") <= batch_id))
            past = past.join(met.filter("_late").select(*keys), keys, "left_semi").select(*keys, "t", "seq", "q")
            done = done.unionByName(N.rebuild(past, keys).select(*keys, *N.STATE))
        seen = F.greatest(F.col("_last"), F.struct(F.col("_seen.last_t").alias("t"), F.col("_seen.last_seq").alias("seq")))
        after = met.select(*keys, seen.alias("_at"), (F.col("_n") + F.coalesce("reviews", F.lit(0))).alias("reviews"))
        done = done.join(after, keys).select(
            *keys, *N.STATE, "reviews", F.col("_at.t").alias("last_t"), F.col("_at.seq").alias("last_seq"), F.lit(batch_id).alias("batch_no")
        )
        done.write.mode("overwrite").parquet(f"{versions}/batch={batch_id}")

    query = outcomes.filter(" and ".join(f"{k} is not null" for k in keys)).writeStream.option("checkpointLocation", f"{root}/progress")
    query.trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return versions


def latest_versions(spark: SparkSession, folder: str | DataFrame, keys: list[str], stamp: str, tie: tuple[str, ...] = ()) -> DataFrame:
    """Merge-on-read over all batches (a folder or its rows): the row with the greatest stamp per key, the greatest `tie` on equal ones.

    Without `tie` the later batch wins.
    """
    rows = spark.read.parquet(folder) if isinstance(folder, str) else folder
    rows = rows.withColumnRenamed("batch", "device_rank")
    return M.lww(rows, keys, F.struct(stamp, *tie))


def merge_log(stream: DataFrame, keys: list[str], stamp: str, name: str = "merge", tie: tuple[str, ...] = ()) -> str:
    """Continuous last-write-wins merge: every batch appends its own winners, readers merge.

    The cost of a batch is the size of the batch, an older stamp can never beat a newer one, and
    replaying a batch changes nothing.
    """
    return run_to_folder(
        stream, name, "append", lambda b: M.lww(b.withColumn("device_rank", F.lit(0)), keys, F.struct(stamp, *tie))
    )


def compact(spark: SparkSession, folder: str, target: str, keys: list[str], stamp: str, tie: tuple[str, ...] = ()) -> None:
    """Write the merged table as one new version, equal stamps settled by `tie` as readers would."""
    latest_versions(spark, folder, keys, stamp, tie).write.mode("overwrite").parquet(target)
