"""Spaced-repetition queries and their recursive SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sm2
from ..operators import schedule as N
from ..sources import adapters as A
from .history import graded
from .registry import query
from .views import NOW


def step_sql(q: str, reps: str, interval: str, ease: str, t: str) -> str:
    """Select-list text of one SM-2 step."""
    # the ease moves in whole hundredths
    gap = f"(5 - least(5, greatest(0, {q})))"
    e = f"(greatest(130, round({ease} * 100)::BIGINT + 10 - {gap} * (8 + {gap} * 2)) / 100.0::DOUBLE)"
    return f"""CASE WHEN {q} < 3 THEN 0 ELSE {reps} + 1 END::BIGINT AS repetitions,
      CASE WHEN {q} < 3 OR {reps} = 0 THEN 1.0::DOUBLE WHEN {reps} = 1 THEN 6.0::DOUBLE
        ELSE floor({interval} * {e} + 0.5::DOUBLE) END AS interval_days,
      {e} AS ease_factor, {t} AS last_reviewed_at"""


DUE_SQL = "(last_reviewed_at + interval_days * 86400000)::BIGINT AS due_at"


def fold_sql(src: str, keys: str) -> str:
    """CTEs `ev`, `f`, `folded` replaying `src` (keys, t, seq, q) in time order."""
    ks = keys.split(", ")
    on = " AND ".join(f"ev.{k} = f.{k}" for k in ks)
    evk = ", ".join(f"ev.{k}" for k in ks)
    return f"""ev AS (SELECT {keys}, t, q, row_number() OVER (PARTITION BY {keys} ORDER BY t, seq) AS rn FROM ({src})),
  f AS (SELECT {keys}, rn, {step_sql("q", "0", "1.0::DOUBLE", "2.5::DOUBLE", "t")} FROM ev WHERE rn = 1
    UNION ALL SELECT {evk}, ev.rn, {step_sql("ev.q", "f.repetitions", "f.interval_days", "f.ease_factor", "ev.t")}
    FROM f JOIN ev ON {on} AND ev.rn = f.rn + 1),
  folded AS (SELECT {keys}, rn AS reviews, repetitions, interval_days, ease_factor, {DUE_SQL}, last_reviewed_at FROM f
    QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY rn DESC) = 1)"""


EVENT_OUTCOMES = "SELECT user_id, item, ts_us // 1000 AS t, event_id AS seq, floor(value)::INT % 6 AS q FROM v_events"


def event_outcomes(spark, d):
    return A.events(spark, d).select(
        "user_id", "item", F.floor(F.col("ts_us") / 1000).cast("bigint").alias("t"), F.col("event_id").alias("seq"),
        (F.floor("value") % 6).cast("int").alias("q"),
    )


@query("sm2_fold", "v_events", f"WITH {fold_sql(EVENT_OUTCOMES, 'user_id, item')} SELECT * FROM folded")
def sm2_fold(spark, d):
    return N.rebuild(event_outcomes(spark, d), ["user_id", "item"])


HISTORY_OUTCOMES = """SELECT user_id, question_id, timestamp AS t, seq,
  CASE WHEN NOT correct THEN 1 WHEN flagged THEN 3 ELSE 4 END AS q FROM v_attempts WHERE answer IS NOT NULL"""


@query("srs_rebuild", "v_attempts", f"WITH {fold_sql(HISTORY_OUTCOMES, 'user_id, question_id')} SELECT * FROM folded")
def srs_rebuild(spark, d):
    a = A.attempts(spark, d).filter("answer is not null")
    outcomes = a.select(
        "user_id", "question_id", F.col("timestamp").alias("t"), "seq",
        sm2.quality_from_outcome("correct", "flagged").alias("q"),
    )
    return N.rebuild(outcomes, ["user_id", "question_id"])


TALLY_SQL = """SELECT user_id, session_id, finished_at, topics[1] AS slug, count(*) AS total,
  count(*) FILTER (correct AND NOT flagged) AS correct FROM v_graded
WHERE finished_at IS NOT NULL AND response IS NOT NULL AND NOT annulled AND len(topics) > 0 GROUP BY ALL"""
TALLY_Q = "floor((correct + 1) / (total + 2) * 5 + 0.5::DOUBLE)::INT"


@query("topic_tally", "v_graded", TALLY_SQL)
def topic_tally(spark, d):
    return N.topic_tally(graded(spark, d))


@query("topic_sm2_fold", "v_graded", f"""WITH {fold_sql(
    f"SELECT user_id, slug, finished_at AS t, session_id AS seq, {TALLY_Q} AS q FROM ({TALLY_SQL})", 'user_id, slug')}
SELECT * FROM folded""")
def topic_sm2_fold(spark, d):
    outcomes = N.topic_tally(graded(spark, d)).select(
        "user_id", "slug", F.col("finished_at").alias("t"), F.col("session_id").alias("seq"),
        sm2.quality_from_accuracy("correct", "total").alias("q"),
    )
    return N.rebuild(outcomes, ["user_id", "slug"])


@query("sm2_quality", "v_graded", f"""
SELECT user_id, session_id, slug, correct, total, {TALLY_Q} AS quality FROM ({TALLY_SQL})""")
def sm2_quality(spark, d):
    return N.topic_tally(graded(spark, d)).select(
        "user_id", "session_id", "slug", "correct", "total", sm2.quality_from_accuracy("correct", "total").alias("quality")
    )


UPDATES_SQL = f"""SELECT user_id, session_id, pos, question_id, repetitions, interval_days, ease_factor, {DUE_SQL},
  last_reviewed_at FROM (SELECT g.user_id, g.session_id, g.pos, g.question_id,
  {step_sql("CASE WHEN NOT g.correct THEN 1 WHEN g.flagged THEN 3 ELSE 4 END", "coalesce(s.repetitions, 0)",
            "coalesce(s.interval_days, 1)::DOUBLE", "coalesce(s.ease_factor, 2.5::DOUBLE)", "g.finished_at")}
  FROM v_graded g LEFT JOIN v_srs s USING (user_id, question_id)
  WHERE g.finished_at IS NOT NULL AND g.response IS NOT NULL)"""


@query("srs_updates", "v_graded v_srs", UPDATES_SQL)
def srs_updates(spark, d):
    return N.srs_updates(graded(spark, d), A.srs(spark, d))


def applied_sql(stored: str, src: str, keys: str) -> str:
    """CTEs `ev`, `f`, `applied`: `src` (keys, t, seq, q) stepped one by one from the stored rows, one row per key."""
    ks = keys.split(", ")
    on = " AND ".join(f"ev.{k} = f.{k}" for k in ks)
    evk = ", ".join(f"ev.{k}" for k in ks)
    return f"""ev AS (SELECT {keys}, t, q, row_number() OVER (PARTITION BY {keys} ORDER BY t, seq) AS rn FROM ({src})),
  f AS (SELECT {evk}, rn, {step_sql("ev.q", "coalesce(s.repetitions, 0)", "coalesce(s.interval_days, 1)::DOUBLE",
                                    "coalesce(s.ease_factor, 2.5::DOUBLE)", "ev.t")}
    FROM ev LEFT JOIN {stored} s USING ({keys}) WHERE rn = 1
    UNION ALL SELECT {evk}, ev.rn, {step_sql("ev.q", "f.repetitions", "f.interval_days", "f.ease_factor", "ev.t")}
    FROM f JOIN ev ON {on} AND ev.rn = f.rn + 1),
  applied AS (SELECT {keys}, repetitions, interval_days, ease_factor, {DUE_SQL}, last_reviewed_at FROM f
    QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY rn DESC) = 1
    UNION ALL SELECT {keys}, repetitions, interval_days::DOUBLE, ease_factor, due_at, last_reviewed_at
    FROM {stored} ANTI JOIN ev USING ({keys}))"""


@query("srs_upsert", "v_graded v_srs", f"""WITH {applied_sql("v_srs", """SELECT user_id, question_id, finished_at AS t,
  (session_id, pos) AS seq, CASE WHEN NOT correct THEN 1 WHEN flagged THEN 3 ELSE 4 END AS q FROM v_graded
  WHERE finished_at IS NOT NULL AND response IS NOT NULL""", "user_id, question_id")} SELECT * FROM applied""")
def srs_upsert(spark, d):
    return N.apply_outcomes(A.srs(spark, d), N.item_outcomes(graded(spark, d)), ["user_id", "question_id"])


@query("topic_srs_upsert", "v_graded v_topic_srs", f"""WITH {applied_sql("v_topic_srs", f"""SELECT user_id, slug,
  finished_at AS t, session_id AS seq, {TALLY_Q} AS q FROM ({TALLY_SQL})""", "user_id, slug")} SELECT * FROM applied""")
def topic_srs_upsert(spark, d):
    outcomes = N.topic_tally(graded(spark, d)).select(
        "user_id", "slug", F.col("finished_at").alias("t"), F.col("session_id").alias("seq"),
        sm2.quality_from_accuracy("correct", "total").alias("q"),
    )
    return N.apply_outcomes(A.topic_srs(spark, d), outcomes, ["user_id", "slug"])


@query("topic_srs_updates", "v_graded v_topic_srs", f"""
SELECT user_id, session_id, slug, last_accuracy, repetitions, interval_days, ease_factor, {DUE_SQL}, last_reviewed_at
FROM (SELECT t.user_id, t.session_id, t.slug, t.correct / t.total AS last_accuracy,
  {step_sql("floor((t.correct + 1) / (t.total + 2) * 5 + 0.5::DOUBLE)::INT", "coalesce(s.repetitions, 0)",
            "coalesce(s.interval_days, 1)::DOUBLE", "coalesce(s.ease_factor, 2.5::DOUBLE)", "t.finished_at")}
  FROM ({TALLY_SQL}) t LEFT JOIN v_topic_srs s USING (user_id, slug))""")
def topic_srs_updates(spark, d):
    return N.topic_srs_updates(N.topic_tally(graded(spark, d)), A.topic_srs(spark, d))


def _due_sql(view, item):
    return f"""SELECT user_id, {item}, due_at, row_number() OVER (PARTITION BY user_id ORDER BY due_at, {item})::INT AS rank,
      count(*) OVER (PARTITION BY user_id) AS due_total FROM {view} WHERE due_at <= {NOW} QUALIFY rank <= 20"""


# the schedules also hold items that have left the bank
@query("due_questions", "v_srs_all v_questions", _due_sql("v_srs_all SEMI JOIN v_questions USING (question_id)", "question_id"))
def due_questions(spark, d):
    return N.due(A.srs_all(spark, d), A.NOW, bank=A.questions(spark, d))


@query("due_topics", "v_topic_srs", _due_sql("v_topic_srs", "slug"))
def due_topics(spark, d):
    return N.due(A.topic_srs(spark, d), A.NOW, item="slug")


@query("due_truncation", "v_srs_all v_questions", f"""
SELECT user_id, least(count(*), 20) AS shown, count(*) AS due_total,
  'Revisao de questoes (' || least(count(*), 20) || CASE WHEN count(*) > 20 THEN ' de ' || count(*) ELSE '' END || 'q)' AS label
FROM v_srs_all SEMI JOIN v_questions USING (question_id) WHERE due_at <= {NOW} GROUP BY user_id""")
def due_truncation(spark, d):
    from ..operators.sampling import truncation_label

    known = A.srs_all(spark, d).join(A.questions(spark, d).select("question_id"), "question_id", "left_semi")
    counts = known.filter(F.col("due_at") <= A.NOW).groupBy("user_id").agg(F.count("*").alias("due_total"))
    shown = F.least("due_total", F.lit(20).cast("bigint"))
    return counts.select(
        "user_id", shown.alias("shown"), "due_total", truncation_label("Revisao de questoes", shown, "due_total").alias("label")
    )


def _agenda_sql(view):
    return f"""SELECT user_id, count(*) AS tracked, count(*) FILTER (due_at <= {NOW}) AS due,
      greatest(0, ceil((min(due_at) FILTER (due_at > {NOW}) - {NOW}) / 86400000)::BIGINT)
        * CASE WHEN count(*) > count(*) FILTER (due_at <= {NOW}) THEN 1 END AS next_in_days
    FROM {view} GROUP BY user_id"""


query("agenda", "v_topic_srs", _agenda_sql("v_topic_srs"))(lambda spark, d: N.agenda(A.topic_srs(spark, d), A.NOW))
query("agenda_questions", "v_srs", _agenda_sql("v_srs"))(lambda spark, d: N.agenda(A.srs(spark, d), A.NOW))
