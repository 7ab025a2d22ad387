"""Review-mark queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import core as fx
from ..operators import history as H
from ..operators import marks as R
from ..operators import scoring as S
from ..sources import adapters as A
from .history import PACE_SQL, graded
from .registry import query

MARK_COLS = "reason, note, session_id, created_at, updated_at, resolved_at, times_marked"


def sizes(spark, d):
    return A.raw_items(spark, d).groupBy("session_id").agg(F.count("*").alias("items"))


REF_SQL = f"""pace AS ({PACE_SQL}), size AS (SELECT session_id, count(*) AS items FROM v_raw_items GROUP BY ALL),
  ref AS (SELECT g.*, coalesce(g.time_limit_seconds / items, avg_seconds) AS ref,
      CASE WHEN NOT correct THEN 'erro' WHEN seconds > coalesce(g.time_limit_seconds / items, avg_seconds) * 2 THEN 'lento'
        ELSE 'chute' END AS suggested
    FROM v_graded g JOIN size USING (session_id) LEFT JOIN (SELECT session_id, avg_seconds FROM pace) USING (session_id))"""


@query("suggest_reason", "v_graded v_raw_items", f"""
WITH {REF_SQL} SELECT user_id, session_id, pos, question_id, suggested AS reason FROM ref""")
def suggest_reason(spark, d):
    g = graded(spark, d)
    return R.suggestions(g, sizes(spark, d), S.pacing(g))


# the sessions of a user one after the other: a seeded mark is open and keeps the later ones away
SEED_SQL = f"""{REF_SQL}, seeded AS (
SELECT g.user_id, g.question_id, g.pos, suggested AS reason, coalesce(m.note, '') AS note, g.session_id,
  coalesce(m.created_at, g.finished_at) AS created_at, g.finished_at AS updated_at,
  coalesce(m.times_marked, 0) + CASE WHEN m.user_id IS NULL OR m.resolved_at IS NOT NULL THEN 1 ELSE 0 END AS times_marked
FROM ref g LEFT JOIN v_marks m USING (user_id, question_id)
WHERE g.finished_at IS NOT NULL AND flagged
  AND NOT (m.user_id IS NOT NULL AND (m.resolved_at IS NULL OR m.updated_at >= g.finished_at))
QUALIFY row_number() OVER (PARTITION BY g.user_id, g.question_id ORDER BY g.finished_at, g.session_id, g.pos) = 1)"""


def seeded(spark, d):
    g = graded(spark, d)
    return R.seed_marks(g, A.marks(spark, d), S.pacing(g), sizes(spark, d))


@query("seed_marks", "v_graded v_raw_items v_marks", f"WITH {SEED_SQL} SELECT * FROM seeded")
def seed_marks(spark, d):
    # a fresh mark is open: resolved_at is always null here
    return seeded(spark, d).drop("resolved_at")


@query("marks_upsert", "v_graded v_raw_items v_marks", f"""
WITH {SEED_SQL} SELECT user_id, question_id, {MARK_COLS} FROM v_marks ANTI JOIN seeded USING (user_id, question_id)
UNION ALL SELECT user_id, question_id, reason, note, session_id, created_at, updated_at, NULL, times_marked FROM seeded""")
def marks_upsert(spark, d):
    return R.save_marks(A.marks(spark, d), seeded(spark, d))


@query("mark_apply", "v_attempts v_marks", """
WITH i AS (SELECT user_id, question_id, arg_max(session_id, (timestamp, seq)) AS session_id, max(timestamp) AS now
  FROM v_attempts WHERE NOT correct GROUP BY ALL)
SELECT i.user_id, i.question_id, 'erro' AS reason, coalesce(m.note, '') AS note, i.session_id,
  coalesce(m.created_at, now) AS created_at, now AS updated_at,
  coalesce(m.times_marked, 0) + CASE WHEN m.user_id IS NULL OR m.resolved_at IS NOT NULL THEN 1 ELSE 0 END AS times_marked
FROM i LEFT JOIN v_marks m USING (user_id, question_id)""")
def mark_apply(spark, d):
    wrong = A.attempts(spark, d).filter("not correct")
    inputs = wrong.groupBy("user_id", "question_id").agg(
        F.max_by("session_id", F.struct("timestamp", "seq")).alias("session_id"), F.max("timestamp").alias("at")
    )
    return R.apply_marks(A.marks(spark, d), inputs.withColumn("reason", F.lit("erro"))).drop("resolved_at")


LOG_SQL = """SELECT user_id, item AS question_id, ts_us // 1000 AS t, event_id AS seq, event_id AS session_id,
  CASE type WHEN 'click' THEN 'mark' WHEN 'purchase' THEN 'resolve' WHEN 'view' THEN 'unresolve' WHEN 'signup' THEN 'edit'
    ELSE 'toggle' END AS action, ['erro', 'chute', 'lento', 'duvida'][(floor(value)::INT % 4 + 1)] AS reason FROM v_events"""


def mark_log(spark, d):
    actions = {"click": "mark", "purchase": "resolve", "view": "unresolve", "signup": "edit", "error": "toggle"}
    reasons = F.array(*[F.lit(r) for r in fx.REASONS])
    return A.events(spark, d).select(
        "user_id",
        F.col("item").alias("question_id"),
        F.floor(F.col("ts_us") / 1000).cast("bigint").alias("at"),
        F.col("event_id").alias("seq"),
        F.col("event_id").alias("session_id"),
        fx.label_of("type", actions).alias("action"),
        F.element_at(reasons, (F.floor("value") % 4 + 1).cast("int")).alias("reason"),
    )


@query("mark_replay", "v_events", f"""
WITH ev AS (SELECT *, row_number() OVER (PARTITION BY user_id, question_id ORDER BY t, seq) AS rn FROM ({LOG_SQL})
    -- nothing happens before the first mark
    QUALIFY max(action = 'mark') OVER (PARTITION BY user_id, question_id ORDER BY t, seq)),
  first AS (SELECT user_id, question_id, min(rn) AS rn FROM ev GROUP BY ALL),
  f AS (SELECT user_id, question_id, rn, reason, session_id, t AS created_at, t AS updated_at, NULL::BIGINT AS resolved_at,
      1::BIGINT AS times_marked FROM ev SEMI JOIN first USING (user_id, question_id, rn)
    UNION ALL
    SELECT f.user_id, f.question_id, ev.rn,
      CASE WHEN action IN ('mark', 'edit') THEN ev.reason ELSE f.reason END,
      CASE WHEN action = 'mark' THEN ev.session_id ELSE f.session_id END,
      f.created_at, ev.t,
      CASE WHEN action = 'resolve' OR (action = 'toggle' AND f.resolved_at IS NULL) THEN ev.t END,
      f.times_marked + CASE WHEN action IN ('mark', 'toggle') AND f.resolved_at IS NOT NULL THEN 1 ELSE 0 END
    FROM f JOIN ev ON ev.user_id = f.user_id AND ev.question_id = f.question_id AND ev.rn = f.rn + 1)
SELECT user_id, question_id, reason, '' AS note, session_id, created_at, updated_at, resolved_at, times_marked
FROM f QUALIFY row_number() OVER (PARTITION BY user_id, question_id ORDER BY rn DESC) = 1""")
def mark_replay(spark, d):
    return R.replay(mark_log(spark, d))


@query("marks_by_reason", "v_marks", "SELECT user_id, "
       + ", ".join(f"count(*) FILTER (reason = '{r}') AS {r}" for r in fx.REASONS)
       + ", count(*) AS open_total FROM v_marks WHERE resolved_at IS NULL GROUP BY user_id")
def marks_by_reason(spark, d):
    return R.marks_by_reason(A.marks(spark, d))


@query("marks_by_topic", "v_marks v_questions", """
SELECT user_id, slug, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, slug)::INT AS rank
FROM (SELECT user_id, topics[1] AS slug, count(*) AS n FROM v_marks JOIN v_questions USING (question_id)
  WHERE resolved_at IS NULL AND len(topics) > 0 GROUP BY ALL)""")
def marks_by_topic(spark, d):
    return R.marks_by_topic(A.marks(spark, d), A.questions(spark, d))


@query("open_marks", "v_marks", "SELECT user_id, question_id, reason, created_at FROM v_marks WHERE resolved_at IS NULL")
def open_marks(spark, d):
    return R.open_marks(A.marks(spark, d))


@query("marks_known", "v_marks v_questions", f"""
SELECT user_id, question_id, {MARK_COLS} FROM v_marks SEMI JOIN v_questions USING (question_id)""")
def marks_known(spark, d):
    return R.filter_marks(A.marks(spark, d), A.questions(spark, d))


@query("marks_filter", "v_marks v_questions", f"""
SELECT user_id, question_id, {MARK_COLS} FROM v_marks SEMI JOIN v_questions USING (question_id)
WHERE resolved_at IS NOT NULL AND reason = 'chute'""")
def marks_filter(spark, d):
    return R.filter_marks(A.marks(spark, d), A.questions(spark, d), "resolved", "chute")


@query("marks_last_answer", "v_marks v_attempts", """
SELECT user_id, question_id, reason, created_at, answer, correct FROM v_marks LEFT JOIN (
  SELECT user_id, question_id, answer, correct FROM v_attempts
  QUALIFY row_number() OVER (PARTITION BY user_id, question_id ORDER BY timestamp DESC, seq ASC) = 1)
USING (user_id, question_id) WHERE resolved_at IS NULL""")
def marks_last_answer(spark, d):
    last = H.latest_attempt(A.attempts(spark, d), tie="first").select("user_id", "question_id", "answer", "correct")
    return R.open_marks(A.marks(spark, d)).join(last, ["user_id", "question_id"], "left")
