"""Snapshot documents, keyed stores and side files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import core as fx
from ..sources import adapters as A
from ..sources import bank as B
from ..sources import sidefiles, snapshots
from .history import SCRATCH_SQL, scratch
from .registry import query


def documents(spark, d):
    """One snapshot document per session; open sessions yield truncated JSON, "low" ones lack attempts."""
    i = A.raw_items(spark, d)
    attempt = F.struct(
        F.col("question_id").cast("string").alias("questionId"),
        F.col("session_id").cast("string").alias("sessionId"),
        F.col("seen_at").alias("timestamp"),
        F.col("response").alias("answer"),
        (F.col("response") == "A").alias("correct"),
        F.when(F.col("flagged"), F.col("seconds")).alias("secondsSpent"),
    )
    a = i.groupBy("session_id").agg(F.collect_list(attempt).alias("attempts"))
    s = A.sessions(spark, d).join(a, "session_id", "left")
    session = F.struct(
        F.col("session_id").cast("string").alias("id"),
        "mode",
        "label",
        F.col("created_at").alias("createdAt"),
        F.col("finished_at").alias("finishedAt"),
        F.col("correction_mode").alias("correctionMode"),
        F.col("elapsed_seconds").alias("elapsedSeconds"),
    )
    doc = F.struct(
        F.lit(3).alias("version"),
        F.array(session).alias("sessions"),
        F.when(F.col("mode") != "low", F.coalesce("attempts", F.array())).alias("attempts"),
        F.when(
            F.col("mode") == "high", F.create_map(F.col("session_id").cast("string"), F.col("created_at"))
        ).alias("deletedSessions"),
    )
    text = F.to_json(doc)
    return s.select(
        "user_id",
        F.col("session_id").alias("doc_id"),
        F.when(F.col("finished_at").isNull(), F.substring(text, 1, 40)).otherwise(text).alias("data"),
    )


PARSED_SQL = """p AS (SELECT user_id, session_id AS doc_id, mode, finished_at IS NOT NULL AND mode <> 'low' AS valid FROM v_sessions),
  n AS (SELECT session_id AS doc_id, count(*) AS k FROM v_raw_items GROUP BY ALL)"""


@query("snapshot_parse", "v_sessions v_raw_items", f"""
WITH {PARSED_SQL}
SELECT user_id, doc_id, valid, 5 AS version, CASE WHEN valid THEN 1 ELSE 0 END AS n_sessions,
  CASE WHEN valid THEN coalesce(k, 0) ELSE 0 END::INT AS n_attempts, CASE WHEN valid AND mode = 'high' THEN 1 ELSE 0 END AS n_deleted
FROM p LEFT JOIN n USING (doc_id)""")
def snapshot_parse(spark, d):
    return snapshots.parse(documents(spark, d)).select(
        "user_id", "doc_id", "valid", "doc.version", F.size("doc.sessions").alias("n_sessions"),
        F.size("doc.attempts").alias("n_attempts"), F.size("doc.deletedSessions").alias("n_deleted"),
    )


@query("import_counts", "v_sessions v_raw_items", f"""
WITH {PARSED_SQL}
SELECT user_id, count(*) FILTER (NOT valid) AS rejected, count(*) FILTER (valid) AS sessions,
  coalesce(sum(CASE WHEN valid THEN k END), 0)::BIGINT AS attempts FROM p LEFT JOIN n USING (doc_id) GROUP BY user_id""")
def import_counts(spark, d):
    parsed = snapshots.parse(documents(spark, d))
    return parsed.groupBy("user_id").agg(
        F.count_if(~F.col("valid")).alias("rejected"),
        F.sum(F.size("doc.sessions")).alias("sessions"),
        F.sum(F.size("doc.attempts")).alias("attempts"),
    )


@query("snapshot_explode", "v_items v_sessions", """
SELECT i.user_id, i.session_id::VARCHAR AS session_id, question_id::VARCHAR AS question_id, seen_at AS timestamp,
  response AS answer, response = 'A' AS correct, CASE WHEN flagged THEN seconds ELSE 0 END AS seconds_spent
FROM v_items i JOIN v_sessions s USING (session_id) WHERE s.finished_at IS NOT NULL AND mode <> 'low'""")
def snapshot_explode(spark, d):
    return snapshots.attempts(snapshots.parse(documents(spark, d))).drop("seq")


@query("snapshot_sessions", "v_sessions", """
SELECT user_id, session_id::VARCHAR AS session_id, mode, label, created_at, finished_at, correction_mode, elapsed_seconds,
  coalesce(finished_at, created_at) AS updated_at, 0 AS n_absences FROM v_sessions
WHERE finished_at IS NOT NULL AND mode <> 'low'""")
def snapshot_sessions(spark, d):
    return snapshots.sessions(snapshots.parse(documents(spark, d))).select(
        "user_id", "session_id", "mode", "label", "created_at", "finished_at", "correction_mode", "elapsed_seconds",
        "updated_at", F.size("absences").alias("n_absences"),
    )


@query("snapshot_tombstones", "v_sessions", """
SELECT user_id, session_id::VARCHAR AS session_id, created_at AS deleted_at FROM v_sessions
WHERE finished_at IS NOT NULL AND mode = 'high'""")
def snapshot_tombstones(spark, d):
    return snapshots.tombstones(snapshots.parse(documents(spark, d)))


@query("snapshot_export")
def snapshot_export(spark, d):
    return snapshots.export(snapshots.parse(documents(spark, d)), ("user_id", "doc_id"))


USER_DATA = """st AS (SELECT c_custkey AS user_id, c_name AS data, c_custkey * 1000 AS updated_at FROM customer),
  inc AS (SELECT o_custkey AS user_id, max(o_orderkey)::VARCHAR AS data, max(o_orderkey) * 100 AS updated_at FROM orders GROUP BY ALL)"""


def user_data(spark, d):
    # customers without orders are stored only
    c = A.table(spark, d, "customer")
    stored = c.select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("data"), (F.col("c_custkey") * 1000).alias("updated_at")
    )
    inc = A.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.max("o_orderkey").alias("k"))
    return stored, inc.select("user_id", F.col("k").cast("string").alias("data"), (F.col("k") * 100).alias("updated_at"))


@query("user_upsert", "", f"""
WITH {USER_DATA} SELECT user_id, data, updated_at FROM (SELECT *, 0 AS r FROM st UNION ALL SELECT *, 1 FROM inc)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, r DESC) = 1""")
def user_upsert(spark, d):
    return snapshots.upsert_user_data(*user_data(spark, d))


@query("user_reset", "", f"""
WITH {USER_DATA} SELECT * FROM st WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def user_reset(spark, d):
    gone = A.table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    return snapshots.reset_users(user_data(spark, d)[0], gone)


# every third file is asked for by somebody else, who gets nothing
@query("owner_scope", "v_sessions", """
SELECT user_id || '/' || session_id || '.json' AS path, user_id::VARCHAR AS owner FROM v_sessions WHERE session_id % 3 <> 0""")
def owner_scope(spark, d):
    path = F.concat_ws("/", "user_id", F.concat(F.col("session_id").cast("string"), F.lit(".json")))
    asking = F.col("user_id") + F.when(F.col("session_id") % 3 == 0, 1).otherwise(0)
    files = A.sessions(spark, d).select(path.alias("path"), asking.cast("string").alias("owner"))
    return files.filter(snapshots.path_owner("path") == F.col("owner"))


@query("scratch_fetch", "v_sessions", f"""
WITH sc AS (SELECT user_id, session_id, question_id, text, drawing, mode FROM ({SCRATCH_SQL}) JOIN v_sessions USING (session_id)
    WHERE length(trim(text)) > 0 OR length(drawing) > 0),
  mine AS (SELECT * FROM sc WHERE drawing = '' AND mode <> 'low')
SELECT * EXCLUDE (mode), 'local' AS origin FROM mine
UNION ALL SELECT * EXCLUDE (mode), 'remote' FROM sc ANTI JOIN mine USING (user_id, session_id)""")
def scratch_fetch(spark, d):
    s = A.sessions(spark, d).select("user_id", "session_id", "mode")
    sc = scratch(spark, d).join(s, "session_id").select("user_id", "session_id", "question_id", "text", "drawing", "mode")
    return sidefiles.fetch(sc.filter("drawing = '' and mode <> 'low'").drop("mode"), sc.drop("mode"))


@query("carry_over", "v_questions", """
SELECT question_id, CASE WHEN area = 'tecnologia' THEN '' ELSE array_to_string(topics, '+') END AS topics FROM v_questions""")
def carry_over(spark, d):
    q = A.questions(spark, d)
    prev = q.filter("area <> 'tecnologia'").select("question_id", "topics")
    return B.carry_over(q.select("question_id", "topics"), prev, "question_id").select(
        "question_id", F.concat_ws("+", "topics").alias("topics")
    )


@query("years_missing", "v_questions v_sessions", """
SELECT DISTINCT year(make_timestamp(created_at * 1000))::INT AS year FROM v_sessions
WHERE year(make_timestamp(created_at * 1000)) NOT IN (SELECT year FROM v_questions)""")
def years_missing(spark, d):
    asked = A.sessions(spark, d).select(F.year(F.timestamp_millis("created_at")).alias("year"))
    return B.missing_years(asked, A.questions(spark, d).select("year").distinct())
