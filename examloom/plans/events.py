"""Event-log queries, batch and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import eventlog as E
from ..session import shared_dir
from ..sources import adapters as A
from ..streaming import bursts, jobs
from .registry import query
from .schedule import EVENT_OUTCOMES, fold_sql

DELAY_US = 6 * 3600 * 1_000_000  # the supplied events are hours apart, so bursts use a delay to match


@query("dwell_time", "v_events", """
SELECT user_id, item, sum(coalesce(nxt - ts_us, 0))::BIGINT / 1000000.0::DOUBLE AS seconds, count(*) AS visits
FROM (SELECT *, lead(ts_us) OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS nxt FROM v_events) GROUP BY ALL""")
def dwell_time(spark, d):
    return E.dwell_time(A.events(spark, d))


@query("absence_pairs", "v_events", """
WITH e AS (SELECT *, count(*) FILTER (type = 'view') OVER (PARTITION BY user_id ORDER BY ts_us, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM v_events WHERE type IN ('error', 'view')),
  p AS (SELECT user_id, g, min(ts_us) FILTER (type = 'error') AS since_us, max(ts_us) FILTER (type = 'view') AS back_us
    FROM e GROUP BY ALL)
SELECT user_id, since_us, back_us, floor((back_us // 1000 - since_us // 1000) / 1000 + 0.5::DOUBLE)::BIGINT AS seconds
FROM p WHERE since_us IS NOT NULL AND back_us IS NOT NULL AND seconds >= 1""")
def absence_pairs(spark, d):
    return E.absence_pairs(A.events(spark, d), leave="error", back="view")


@query("auto_finish", "v_events", """
WITH e AS (SELECT *, sum(floor(value)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts_us, event_id)::BIGINT AS elapsed FROM v_events)
SELECT user_id, ts_us AS finished_us, elapsed FROM e WHERE elapsed >= 300
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts_us, event_id) = 1""")
def auto_finish(spark, d):
    e = A.events(spark, d).select("user_id", "ts_us", "event_id", F.floor("value").cast("bigint").alias("seconds"))
    return E.auto_finish(e, 300)


def on_screen(spark, d):
    return E.in_sessions(A.events(spark, d), A.screens(spark, d))


# every event with its session; null outside any session
@query("session_events", "v_screen_events", "SELECT event_id, user_id, ts_us, session_id, limit_seconds FROM v_screen_events")
def session_events(spark, d):
    return on_screen(spark, d).select("event_id", "user_id", "ts_us", "session_id", "limit_seconds")


@query("session_dwell", "v_screen_events", """
SELECT user_id, session_id, item, sum(coalesce(nxt, end_us, ts_us) - ts_us)::BIGINT / 1000000.0::DOUBLE AS seconds, count(*) AS visits
FROM (SELECT *, lead(ts_us) OVER (PARTITION BY session_id ORDER BY ts_us, event_id) AS nxt FROM v_screen_events
  WHERE session_id IS NOT NULL) GROUP BY user_id, session_id, item""")
def session_dwell(spark, d):
    return E.dwell_time(on_screen(spark, d).filter("session_id is not null"), E.SESSION)


@query("session_absences", "v_screen_events", """
WITH e AS (SELECT *, count(*) FILTER (type = 'view') OVER (PARTITION BY session_id ORDER BY ts_us, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g
    FROM v_screen_events WHERE type IN ('error', 'view') AND limit_seconds IS NOT NULL),
  p AS (SELECT user_id, session_id, g, min(ts_us) FILTER (type = 'error') AS since_us, max(ts_us) FILTER (type = 'view') AS back_us
    FROM e GROUP BY ALL)
SELECT user_id, session_id, since_us, back_us, floor((back_us // 1000 - since_us // 1000) / 1000 + 0.5::DOUBLE)::BIGINT AS seconds
FROM p WHERE since_us IS NOT NULL AND back_us IS NOT NULL AND seconds >= 1""")
def session_absences(spark, d):
    return E.session_absences(on_screen(spark, d), leave="error", back="view")


@query("session_timeout", "v_screen_events", """
WITH e AS (SELECT *, sum(floor(value)::BIGINT) OVER (PARTITION BY session_id ORDER BY ts_us, event_id)::BIGINT AS elapsed
    FROM v_screen_events WHERE session_id IS NOT NULL)
SELECT user_id, session_id, ts_us AS finished_us, elapsed FROM e WHERE limit_seconds > 0 AND elapsed >= limit_seconds
QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts_us, event_id) = 1""")
def session_timeout(spark, d):
    e = on_screen(spark, d).filter("session_id is not null").withColumn("seconds", F.floor("value").cast("bigint"))
    return E.auto_finish(e, keys=E.SESSION)


BURST_SQL = f"""b AS (SELECT *, sum(CASE WHEN ts_us - p < {DELAY_US} THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS g
    FROM (SELECT *, lag(ts_us) OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS p FROM v_events)),
  bursts AS (SELECT user_id, min(ts_us) AS burst_us, count(*) AS changes, arg_max(item, (ts_us, event_id)) AS item,
    max(ts_us) + {DELAY_US} AS flush_us FROM b GROUP BY user_id, g)"""


@query("debounce", "v_events", f"WITH {BURST_SQL} SELECT * FROM bursts")
def debounce(spark, d):
    return E.debounce(A.events(spark, d), DELAY_US)


FLUSH_SQL = f"""
WITH n AS (SELECT *, lag(ts_us) OVER w AS pt, lag(type) OVER w AS pty, lead(ts_us) OVER w AS nt, lead(type) OVER w AS nty
    FROM v_events WINDOW w AS (PARTITION BY user_id ORDER BY ts_us, event_id)),
  c AS (SELECT *, sum(CASE WHEN pty IS NULL OR pty = 'signup' OR ts_us - pt >= {DELAY_US} THEN 1 ELSE 0 END)
      OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS g,
    coalesce(nty = 'signup' AND nt < ts_us + {DELAY_US}, FALSE) AS early FROM n WHERE type <> 'signup')
SELECT user_id, min(ts_us) AS burst_us, count(*) AS changes, arg_max(item, (ts_us, event_id)) AS item,
  arg_max(CASE WHEN early THEN nt ELSE ts_us + {DELAY_US} END, (ts_us, event_id)) AS flush_us,
  arg_max(early, (ts_us, event_id)) AS early FROM c GROUP BY user_id, g"""


@query("debounce_flush", "v_events", FLUSH_SQL)
def debounce_flush(spark, d):
    return E.debounce_flush(A.events(spark, d), DELAY_US, "signup")


# the log as a stream that ends: open bursts are released, so the rows are those of the batch form
@query("stream_debounce", "v_events", f"WITH {BURST_SQL} SELECT * FROM bursts")
def stream_debounce(spark, d):
    out = bursts.run(jobs.event_stream(spark, d), DELAY_US, "1 hour")
    return spark.read.schema(bursts.RESULT).parquet(out).drop("batch", "early")


@query("stream_debounce_flush", "v_events", FLUSH_SQL)
def stream_debounce_flush(spark, d):
    out = bursts.run(jobs.event_stream(spark, d), DELAY_US, "1 hour", "signup")
    return spark.read.schema(bursts.RESULT).parquet(out).drop("batch")


@query("stream_dedupe", "v_events", "SELECT DISTINCT user_id, item, type FROM v_events")
def stream_dedupe(spark, d):
    # a lateness bound longer than the log: first record per key only
    s = jobs.exactly_once(jobs.event_stream(spark, d), ["user_id", "item", "type"], "60 days")
    out = jobs.run_to_folder(s.select("user_id", "item", "type"), "dedupe", "append")
    return spark.read.parquet(out).drop("batch")


@query("stream_sm2", "v_events", f"WITH {fold_sql(EVENT_OUTCOMES, 'user_id, item')} SELECT * FROM folded")
def stream_sm2(spark, d):
    out = jobs.running_schedules(jobs.event_outcomes(jobs.event_stream(spark, d)), ["user_id", "item"])
    last = jobs.latest_versions(spark, out, ["user_id", "item"], "batch_no")
    return last.drop("last_t", "last_seq", "batch_no")


@query("stream_merge", "v_events", """
SELECT user_id, item, type, value, ts_us FROM v_events
QUALIFY row_number() OVER (PARTITION BY user_id, item ORDER BY ts_us DESC, event_id DESC) = 1""")
def stream_merge(spark, d):
    s = jobs.event_stream(spark, d).select("user_id", "item", "type", "value", "ts_us", "event_id")
    out = jobs.merge_log(s, ["user_id", "item"], "ts_us", tie=("event_id",))
    table = shared_dir(spark, "merged")
    jobs.compact(spark, out, table, ["user_id", "item"], "ts_us", ("event_id",))
    return spark.read.parquet(table).drop("event_id")
