"""Merge queries over two overlapping device copies of each table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import core as fx
from ..operators import merge as M
from ..session import materialize
from ..sources import adapters as A
from .registry import query
from .views import NOW

SESSION_COLS = ("user_id, session_id, mode, label, created_at, finished_at, correction_mode, time_limit_seconds, "
                "elapsed_seconds, updated_at")

# device A lacks the "low" sessions, device B the "urgent" ones; B's stamps are later, earlier or equal by mode
DEV_SESSIONS = f"""ds AS (SELECT {SESSION_COLS}, 0 AS dev FROM v_sessions WHERE mode <> 'low'
  UNION ALL SELECT user_id, session_id, mode, label || '*', created_at, finished_at, correction_mode, time_limit_seconds,
    elapsed_seconds, updated_at + CASE mode WHEN 'high' THEN 3600000 WHEN 'medium' THEN -3600000 ELSE 0 END, 1
  FROM v_sessions WHERE mode <> 'urgent')"""
DEV_TOMBS = """dt AS (SELECT user_id, session_id, created_at AS deleted_at FROM v_sessions WHERE elapsed_seconds < 2000
  UNION ALL SELECT user_id, session_id, created_at + 5000 FROM v_sessions WHERE elapsed_seconds BETWEEN 1000 AND 3000)"""


def dev_sessions(spark, d):
    s = A.sessions(spark, d)
    shift = F.when(F.col("mode") == "high", 3600000).when(F.col("mode") == "medium", -3600000).otherwise(0)
    a = s.filter("mode <> 'low'").withColumn("device_rank", F.lit(0))
    b = (
        s.filter("mode <> 'urgent'")
        .withColumn("label", F.concat("label", F.lit("*")))
        .withColumn("updated_at", F.col("updated_at") + shift)
        .withColumn("device_rank", F.lit(1))
    )
    return a.unionByName(b)


def dev_tombstones(spark, d):
    s = A.sessions(spark, d)
    a = s.filter("elapsed_seconds < 2000").select("user_id", "session_id", F.col("created_at").alias("deleted_at"))
    b = s.filter("elapsed_seconds between 1000 and 3000").select(
        "user_id", "session_id", (F.col("created_at") + 5000).alias("deleted_at")
    )
    return a.union(b)


@query("merge_tombstones", "v_sessions", f"""
WITH {DEV_TOMBS} SELECT user_id, session_id, max(deleted_at) AS deleted_at FROM dt GROUP BY ALL""")
def merge_tombstones(spark, d):
    return M.merge_tombstones(dev_tombstones(spark, d))


@query("merge_sessions", "v_sessions", f"""
WITH {DEV_SESSIONS}, {DEV_TOMBS}
SELECT * EXCLUDE (dev) FROM ds ANTI JOIN dt USING (user_id, session_id)
QUALIFY row_number() OVER (PARTITION BY user_id, session_id
  ORDER BY coalesce(updated_at, finished_at, created_at) DESC, dev DESC) = 1""")
def merge_sessions(spark, d):
    return M.merge_sessions(dev_sessions(spark, d), dev_tombstones(spark, d))


ATTEMPT_COLS = ["user_id", "session_id", "question_id", "timestamp", "answer", "correct", "seconds_spent"]


def dev_attempts(spark, d, rows=None):
    a = (A.attempts(spark, d) if rows is None else rows).select(*ATTEMPT_COLS)
    left = a.filter("seconds_spent <= 200").withColumn("device_rank", F.lit(0))
    right = a.filter("seconds_spent >= 100").withColumn("seconds_spent", F.col("seconds_spent") + 1)
    return left.unionByName(right.withColumn("device_rank", F.lit(1)))


@query("merge_attempts", "v_attempts", """
SELECT user_id, session_id, question_id, timestamp, answer, correct,
  CASE WHEN seconds_spent >= 100 THEN seconds_spent + 1 ELSE seconds_spent END AS seconds_spent FROM v_attempts""")
def merge_attempts(spark, d):
    return M.merge_attempts(dev_attempts(spark, d))


@query("dedupe_attempts", "v_attempts", """
SELECT DISTINCT user_id, session_id, question_id, timestamp FROM v_attempts""")
def dedupe_attempts(spark, d):
    keys = ["user_id", "session_id", "question_id", "timestamp"]
    return dev_attempts(spark, d).select(*keys).dropDuplicates(keys)


def _lww_sql(cte, keys, stamp, cols):
    return f"""WITH {cte} SELECT {cols} FROM dd
      QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {stamp} DESC, dev DESC) = 1"""


SRS_COLS = "user_id, question_id, repetitions, interval_days, ease_factor, due_at, last_reviewed_at"
DEV_SRS = f"""dd AS (SELECT {SRS_COLS}, 0 AS dev FROM v_srs WHERE repetitions <= 1
  UNION ALL SELECT user_id, question_id, repetitions, interval_days, ease_factor, due_at + 7,
    last_reviewed_at + CASE WHEN interval_days = 6 THEN 0 ELSE -1000 END, 1 FROM v_srs)"""


def dev_srs(spark, d, rows=None):
    s = A.srs(spark, d, rows)
    shift = F.when(F.col("interval_days") == 6, 0).otherwise(-1000)
    b = s.withColumn("due_at", F.col("due_at") + 7).withColumn("last_reviewed_at", F.col("last_reviewed_at") + shift)
    return s.filter("repetitions <= 1").withColumn("device_rank", F.lit(0)).unionByName(b.withColumn("device_rank", F.lit(1)))


@query("merge_srs", "v_srs", _lww_sql(DEV_SRS, "user_id, question_id", "last_reviewed_at", SRS_COLS))
def merge_srs(spark, d):
    return M.merge_srs(dev_srs(spark, d))


TOPIC_SRS_COLS = "user_id, slug, repetitions, interval_days, ease_factor, due_at, last_reviewed_at, last_accuracy"
DEV_TOPIC_SRS = f"""dd AS (SELECT {TOPIC_SRS_COLS}, 0 AS dev FROM v_topic_srs WHERE interval_days <= 3
  UNION ALL SELECT user_id, slug, repetitions, interval_days, ease_factor, due_at + 7,
    last_reviewed_at + CASE WHEN repetitions >= 2 THEN -1000 ELSE 1000 END, last_accuracy, 1
    FROM v_topic_srs WHERE interval_days >= 2)"""


@query("merge_topic_srs", "v_topic_srs", _lww_sql(DEV_TOPIC_SRS, "user_id, slug", "last_reviewed_at", TOPIC_SRS_COLS))
def merge_topic_srs(spark, d):
    return M.merge_topic_srs(dev_topic_srs(spark, d))


def dev_topic_srs(spark, d, rows=None):
    s = A.topic_srs(spark, d, rows)
    shift = F.when(F.col("repetitions") >= 2, -1000).otherwise(1000)
    b = s.filter("interval_days >= 2").withColumn("due_at", F.col("due_at") + 7)
    b = b.withColumn("last_reviewed_at", F.col("last_reviewed_at") + shift).withColumn("device_rank", F.lit(1))
    return s.filter("interval_days <= 3").withColumn("device_rank", F.lit(0)).unionByName(b)


MARK_COLS = "user_id, question_id, reason, note, session_id, created_at, updated_at, resolved_at, times_marked"
DEV_MARKS = f"""dd AS (SELECT {MARK_COLS}, 0 AS dev FROM v_marks
  UNION ALL SELECT user_id, question_id, reason, 'b', session_id, created_at,
    updated_at + CASE WHEN resolved_at IS NULL THEN -1000 ELSE 1000 END, resolved_at, times_marked, 1
    FROM v_marks WHERE reason <> 'lento')"""


@query("merge_marks", "v_marks", _lww_sql(DEV_MARKS, "user_id, question_id", "updated_at", MARK_COLS))
def merge_marks(spark, d):
    return M.merge_marks(dev_marks(spark, d))


def dev_marks(spark, d, rows=None):
    m = A.marks(spark, d, rows)
    shift = F.when(F.col("resolved_at").isNull(), -1000).otherwise(1000)
    b = m.filter("reason <> 'lento'").withColumn("note", F.lit("b"))
    b = b.withColumn("updated_at", F.col("updated_at") + shift).withColumn("device_rank", F.lit(1))
    return m.withColumn("device_rank", F.lit(0)).unionByName(b)


def _kind_sql(name: str, cte: str, keys: str, stamp: str, key: str, value: str, anti: str = "") -> str:
    return f"""SELECT '{name}' AS kind, user_id, {key} AS key, {value} AS value FROM (WITH {cte} SELECT * FROM dd {anti}
      QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {stamp} DESC, dev DESC) = 1)"""


# all six tables; a column of each shows which copy won
@query("merge_all", "v_sessions v_attempts v_srs v_topic_srs v_marks", " UNION ALL ".join([
    _kind_sql("sessions", DEV_SESSIONS.replace("ds AS", "dd AS") + ", " + DEV_TOMBS, "user_id, session_id",
              "coalesce(updated_at, finished_at, created_at)", "session_id::VARCHAR", "label", "ANTI JOIN dt USING (user_id, session_id)"),
    """SELECT 'attempts', user_id, session_id || '/' || question_id || '/' || timestamp,
      floor(CASE WHEN seconds_spent >= 100 THEN seconds_spent + 1 ELSE seconds_spent END)::BIGINT::VARCHAR FROM v_attempts""",
    _kind_sql("srs", DEV_SRS, "user_id, question_id", "last_reviewed_at", "question_id::VARCHAR", "due_at::VARCHAR"),
    _kind_sql("topic_srs", DEV_TOPIC_SRS, "user_id, slug", "last_reviewed_at", "slug", "due_at::VARCHAR"),
    _kind_sql("marks", DEV_MARKS, "user_id, question_id", "updated_at", "question_id::VARCHAR", "note || updated_at"),
    f"SELECT 'tombstones', user_id, session_id::VARCHAR, max(deleted_at)::VARCHAR FROM (WITH {DEV_TOMBS} SELECT * FROM dt) GROUP BY user_id, session_id",
]))
def merge_all(spark, d):
    a = materialize(A.attempts(spark, d), "attempts")  # four tables are made of them
    devices = (dev(spark, d, a) for dev in (dev_attempts, dev_srs, dev_topic_srs, dev_marks))
    out = M.merge_all(dev_sessions(spark, d), *devices, dev_tombstones(spark, d))
    show = {
        "sessions": (["session_id"], F.col("label")), "attempts": (["session_id", "question_id", "timestamp"], F.floor("seconds_spent").cast("string")),
        "srs": (["question_id"], F.col("due_at").cast("string")), "topic_srs": (["slug"], F.col("due_at").cast("string")),
        "marks": (["question_id"], F.concat("note", F.col("updated_at").cast("string"))), "tombstones": (["session_id"], F.col("deleted_at").cast("string")),
    }
    rows = None
    for kind, (keys, value) in show.items():
        key = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
        part = out[kind].select(F.lit(kind).alias("kind"), "user_id", key.alias("key"), value.alias("value"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


@query("migrate", "v_sessions", f"""
SELECT * EXCLUDE (updated_at), coalesce(CASE WHEN mode <> 'low' THEN updated_at END, finished_at, created_at) AS updated_at
FROM v_sessions""")
def migrate(spark, d):
    s = A.sessions(spark, d)
    return M.migrate_sessions(s.withColumn("updated_at", F.when(F.col("mode") != "low", F.col("updated_at"))))


@query("migrate_attempts", "v_attempts", """
SELECT user_id, session_id, question_id, timestamp, answer, correct,
  coalesce(CASE WHEN answer IS NOT NULL THEN seconds_spent END, 0) AS seconds_spent FROM v_attempts""")
def migrate_attempts(spark, d):
    a = A.attempts(spark, d).select(*ATTEMPT_COLS)
    return M.migrate_attempts(a.withColumn("seconds_spent", F.when(F.col("answer").isNotNull(), F.col("seconds_spent"))))


@query("session_delete", "v_sessions", f"""
SELECT {SESSION_COLS} FROM v_sessions WHERE NOT (mode = 'low' AND finished_at IS NULL)""")
def session_delete(spark, d):
    s = A.sessions(spark, d)
    doomed = s.filter("mode = 'low' and finished_at is null")
    return M.delete_sessions(s, dev_tombstones(spark, d), doomed, A.NOW)[0]


@query("session_delete_tombstones", "v_sessions", f"""
WITH {DEV_TOMBS} SELECT user_id, session_id, max(deleted_at) AS deleted_at FROM (SELECT * FROM dt UNION ALL
  SELECT user_id, session_id, {NOW} FROM v_sessions WHERE mode = 'low' AND finished_at IS NULL) GROUP BY ALL""")
def session_delete_tombstones(spark, d):
    s = A.sessions(spark, d)
    doomed = s.filter("mode = 'low' and finished_at is null")
    return M.delete_sessions(s, dev_tombstones(spark, d), doomed, A.NOW)[1]


@query("session_lookup", "v_sessions", f"""
SELECT {SESSION_COLS} FROM v_sessions WHERE session_id = (SELECT max(session_id) FROM v_sessions)""")
def session_lookup(spark, d):
    s = A.sessions(spark, d)
    return M.session(s, s.agg(F.max("session_id")).first()[0])


# the attempts of one device after those of the other, which stay as they are
@query("attempts_append", "v_attempts", """
SELECT user_id, session_id, question_id, timestamp, answer, correct, seconds_spent FROM v_attempts WHERE seconds_spent <= 200
UNION ALL SELECT user_id, session_id, question_id, timestamp, answer, correct, seconds_spent FROM v_attempts WHERE seconds_spent > 300""")
def attempts_append(spark, d):
    a = A.attempts(spark, d).select(*ATTEMPT_COLS)
    return M.append_attempts(a.filter("seconds_spent <= 200"), a.filter("seconds_spent > 300"))


@query("session_upsert", "v_sessions", f"""
SELECT * REPLACE (CASE WHEN finished_at IS NULL THEN {NOW} ELSE updated_at END AS updated_at,
  CASE WHEN finished_at IS NULL THEN elapsed_seconds + 5 ELSE elapsed_seconds END AS elapsed_seconds) FROM v_sessions""")
def session_upsert(spark, d):
    s = A.sessions(spark, d)
    changed = s.filter("finished_at is null").withColumn("elapsed_seconds", F.col("elapsed_seconds") + 5)
    return M.upsert_sessions(s, changed, A.NOW)
