"""What the live exam screen records, computed from event logs.

Input rows carry `user_id` (the session owner), `ts_us`, `event_id` and what the operator needs. A log without session ids
gets them from `in_sessions`; the operators then work per session with `keys=SESSION`, else per user.
Events of one key are cut into days, so a user with very many events spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import intervals, slices

KEYS = ["user_id"]
SESSION = ["user_id", "session_id"]
ORDER = ["ts_us", "event_id"]
SLICE_US = 86_400_000_000


def sliced(events: DataFrame) -> DataFrame:
    return events.withColumn("_day", F.floor(F.col("ts_us") / SLICE_US))


def in_sessions(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Events with the session on screen: session_id, end_us and limit_seconds, null outside any session.

    `sessions` holds user_id, session_id, start_us, end_us (null while open) and limit_seconds (null if untimed). A user who
    opens a session while another is open sees the later one.
    """
    rows = sessions.select("user_id", "session_id", "start_us", "end_us", "limit_seconds")
    take = ["start_us", "session_id", "end_us", "limit_seconds"]
    return intervals.latest(events, rows, ["user_id"], "ts_us", ["event_id"], "start_us", "end_us", take)


def dwell_time(events: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Seconds each item was on screen: from its event to the next one of the key.

    The last item stays until the session ends (`end_us`, where the events have it), else it counts 0.
    """
    end = ["end_us"] if "end_us" in events.columns else []
    e = slices.neighbours(sliced(events.select(*keys, "item", *ORDER, *end)), keys, "_day", ORDER, lead={"_next": "ts_us"})
    spent = F.coalesce(F.coalesce("_next", *end) - F.col("ts_us"), F.lit(0))
    return e.groupBy(*keys, "item").agg((F.sum(spent) / 1_000_000).alias("seconds"), F.count("*").alias("visits"))


def absence_pairs(events: DataFrame, leave: str, back: str, keys: list[str] = KEYS) -> DataFrame:
    """Absences: from the first leave to the next return, in rounded seconds; under one second dropped."""
    e = sliced(events.filter(F.col("type").isin(leave, back)).select(*keys, "type", *ORDER))
    e = slices.neighbours(e, keys, "_day", ORDER, lag={"_before": "type"})
    starts = (F.col("type") == leave) & F.coalesce(F.col("_before") == back, F.lit(True))
    e = slices.carry_start(e, keys, "_day", ORDER, starts, "ts_us", "since_us")
    ended = e.filter((F.col("type") == back) & (F.col("_before") == leave))
    gone = F.floor(ended["ts_us"] / 1000) - F.floor(ended["since_us"] / 1000)
    seconds = F.floor(gone / 1000 + 0.5).cast("bigint")
    return ended.select(*keys, "since_us", F.col("ts_us").alias("back_us"), seconds.alias("seconds")).filter("seconds >= 1")


def session_absences(events: DataFrame, leave: str, back: str) -> DataFrame:
    """Absences inside timed sessions; an absence that the session's end cuts off is none, as nobody came back."""
    return absence_pairs(events.filter("session_id is not null and limit_seconds is not null"), leave, back, SESSION)


def auto_finish(events: DataFrame, limit: int | None = None, keys: list[str] = KEYS) -> DataFrame:
    """First event at which a key's accumulated whole seconds (`seconds`) reach the limit: one for all, or `limit_seconds`."""
    e = events if limit is None else events.withColumn("limit_seconds", F.lit(limit))
    e = e.filter("limit_seconds > 0")
    e = slices.running_sum(sliced(e), keys, "_day", ORDER, {"elapsed": F.col("seconds")})
    done = e.filter(F.col("elapsed") >= F.col("limit_seconds"))
    first = done.groupBy(*keys).agg(F.min(F.struct(*ORDER, "elapsed")).alias("_f"))
    return first.select(*keys, F.col("_f.ts_us").alias("finished_us"), F.col("_f.elapsed").alias("elapsed"))


def debounce(events: DataFrame, delay_us: int) -> DataFrame:
    """Bursts of changes: one upload per burst, `delay` after its last change, with that change's payload."""
    e = slices.neighbours(sliced(events), KEYS, "_day", ORDER, lag={"_before": "ts_us"})
    starts = F.coalesce(F.col("ts_us") - F.col("_before") >= delay_us, F.lit(True))
    e = slices.carry_start(e, KEYS, "_day", ORDER, starts, "ts_us", "burst_us")
    return e.groupBy("user_id", "burst_us").agg(
        F.count("*").alias("changes"),
        F.max_by("item", F.struct(*ORDER)).alias("item"),
        (F.max("ts_us") + delay_us).alias("flush_us"),
    )


def debounce_flush(events: DataFrame, delay_us: int, flush: str) -> DataFrame:
    """As :func:`debounce`, but a `flush` event uploads the open burst at once and closes it."""
    e = slices.neighbours(
        sliced(events), KEYS, "_day", ORDER,
        lag={"_before": "ts_us", "_btype": "type"}, lead={"_after": "ts_us", "_atype": "type"},
    )
    change = F.col("type") != flush
    starts = change & F.coalesce(
        (F.col("_btype") == flush) | (F.col("ts_us") - F.col("_before") >= delay_us), F.lit(True)
    )
    e = slices.carry_start(e, KEYS, "_day", ORDER, starts, "ts_us", "burst_us").filter(change)
    due = F.col("ts_us") + delay_us
    early = F.coalesce((F.col("_atype") == flush) & (F.col("_after") < due), F.lit(False))
    e = e.withColumn("_flush", F.when(early, F.col("_after")).otherwise(due)).withColumn("_early", early)
    last = F.struct(*ORDER)
    return e.groupBy("user_id", "burst_us").agg(
        F.count("*").alias("changes"),
        F.max_by("item", last).alias("item"),
        F.max_by("_flush", last).alias("flush_us"),
        F.max_by("_early", last).alias("early"),
    )
