"""Scoring, history and topic analytics over the stand-in views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import core as fx
from ..operators import history as H
from ..operators import scoring as S
from ..operators import topicstats as T
from ..session import materialize
from ..sources import adapters as A
from .registry import query
from .views import NOW


def graded(spark, d):
    return S.grade(A.items(spark, d), A.questions(spark, d))


def pooled_stats(spark, d):
    latest = H.latest_attempt(A.attempts(spark, d), ("question_id",))
    return T.topic_stats(A.questions(spark, d), A.topics(spark, d), latest)


STATS_SQL = """WITH latest AS (SELECT * FROM v_attempts
    QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY timestamp DESC, seq DESC) = 1),
  yrs AS (SELECT count(DISTINCT year) AS n FROM v_questions),
  recent AS (SELECT DISTINCT year FROM v_questions ORDER BY year DESC LIMIT 5),
  c AS (SELECT slug, count(*) FILTER (tpos = 0) AS primary_count, count(*) AS total_count,
      count(*) FILTER (tpos = 0 AND year IN (SELECT year FROM recent)) AS recent_primary,
      count(answer) AS answered, count(*) FILTER (answer IS NOT NULL AND correct) AS correct
    FROM v_qtopics LEFT JOIN latest USING (question_id) GROUP BY slug),
  z AS (SELECT t.*, coalesce(primary_count, 0) AS primary_count, coalesce(total_count, 0) AS total_count,
      coalesce(answered, 0) AS answered, coalesce(correct, 0) AS correct,
      coalesce(primary_count, 0) / (SELECT n FROM yrs) AS per_exam,
      coalesce(recent_primary, 0) / (SELECT count(*) FROM recent) AS per_exam_recent
    FROM v_topics t LEFT JOIN c USING (slug)),
  a AS (SELECT *, per_exam_recent - per_exam AS trend,
      CASE WHEN answered >= 4 THEN correct / answered END AS accuracy FROM z),
  stats AS (SELECT slug, label, area, primary_count, total_count, per_exam, per_exam_recent, trend, answered, correct,
      accuracy, (per_exam + 2 * per_exam_recent) / 3 * (1 - coalesce(accuracy, 0.5::DOUBLE)) AS priority,
      accuracy IS NULL AS priority_is_estimate FROM a)
"""


@query("topic_stats", "v_attempts v_qtopics v_topics v_questions", STATS_SQL + "SELECT * FROM stats")
def topic_stats(spark, d):
    return pooled_stats(spark, d)


def touched(spark, d):
    return T.user_topic_stats(A.questions(spark, d), A.topics(spark, d), H.latest_attempt(A.attempts(spark, d)))


def everybody(spark, d):
    """Users, what they have touched, and the untouched table."""
    users = A.sessions(spark, d).select("user_id").distinct()
    return users, touched(spark, d), T.default_stats(A.questions(spark, d), A.topics(spark, d))


def _user_stats_sql(members: str) -> str:
    """The topic table of every (user, topic) in `members`, a full product in the oracles below."""
    return f"""WITH yrs AS (SELECT count(DISTINCT year) AS n FROM v_questions),
  recent AS (SELECT DISTINCT year FROM v_questions ORDER BY year DESC LIMIT 5),
  inc AS (SELECT t.slug, t.label, t.area, count(q.slug) AS total_count, count(*) FILTER (tpos = 0) AS primary_count,
      count(*) FILTER (tpos = 0 AND year IN (SELECT year FROM recent)) AS recent_primary
    FROM v_topics t LEFT JOIN v_qtopics q USING (slug) GROUP BY ALL),
  hits AS (SELECT user_id, slug, count(*) AS answered, count(*) FILTER (correct) AS correct
    FROM v_latest JOIN v_qtopics USING (question_id) WHERE answer IS NOT NULL GROUP BY ALL),
  a AS (SELECT user_id, inc.slug, label, area, primary_count, total_count, primary_count / (SELECT n FROM yrs) AS per_exam,
      recent_primary / (SELECT count(*) FROM recent) AS per_exam_recent, coalesce(answered, 0) AS answered,
      coalesce(correct, 0) AS correct, CASE WHEN answered >= 4 THEN correct / answered END AS accuracy FROM {members}),
  stats AS (SELECT *, per_exam_recent - per_exam AS trend,
      (per_exam + 2 * per_exam_recent) / 3 * (1 - coalesce(accuracy, 0.5::DOUBLE)) AS priority,
      accuracy IS NULL AS priority_is_estimate FROM a)
"""


PRODUCT = "(SELECT DISTINCT user_id FROM v_sessions) u CROSS JOIN inc LEFT JOIN hits USING (user_id, slug)"
USER_VIEWS = "v_latest v_qtopics v_topics v_questions v_sessions"
TABLE = "user_id, slug, label, area, primary_count, total_count, per_exam, per_exam_recent, trend, answered, correct, accuracy, priority, priority_is_estimate"


@query("user_topic_stats", USER_VIEWS, _user_stats_sql("hits JOIN inc USING (slug)") + f"SELECT {TABLE} FROM stats")
def user_topic_stats(spark, d):
    return touched(spark, d)


def _user_top_sql(key: str, expr: str, n: int, where: str = "") -> str:
    return f"""SELECT '{key}' AS sort_key, row_number() OVER (PARTITION BY user_id ORDER BY {expr}, slug)::INT AS rank, {TABLE}
      FROM stats WHERE total_count > 0 {where} QUALIFY rank <= {n}"""


# the table's first rows under three sort keys, one of them within an area
@query("user_topic_rank", USER_VIEWS, _user_stats_sql(PRODUCT) + " UNION ALL ".join([
    _user_top_sql("priority", "priority DESC", 10), _user_top_sql("accuracy", "accuracy ASC NULLS LAST", 10),
    _user_top_sql("trend", "trend DESC", 5, "AND area = 'fundamentos'")]))
def user_topic_rank(spark, d):
    users, mine, defaults = (materialize(x, "user-topics") for x in everybody(spark, d))
    parts = [
        T.user_top(users, mine, defaults, key, n, area).select(F.lit(key).alias("sort_key"), "rank", "user_id", *T.STAT_COLUMNS)
        for key, n, area in (("priority", 10, None), ("accuracy", 10, None), ("trend", 5, "fundamentos"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("user_topic_chart", USER_VIEWS, _user_stats_sql(PRODUCT) + """, top AS (SELECT *,
    row_number() OVER (PARTITION BY user_id ORDER BY per_exam_recent DESC, slug)::INT AS rank FROM stats WHERE total_count > 0 QUALIFY rank <= 12)
SELECT user_id, rank, slug, label, area, per_exam_recent AS value,
  per_exam_recent / greatest(1.0::DOUBLE, max(per_exam_recent) OVER (PARTITION BY user_id)) AS bar FROM top""")
def user_topic_chart(spark, d):
    return T.user_chart(*everybody(spark, d), key="recent")


@query("user_study_plan", USER_VIEWS, _user_stats_sql(PRODUCT) + """, top AS (SELECT user_id, slug, label, priority, priority_is_estimate,
    row_number() OVER (PARTITION BY user_id ORDER BY priority DESC, slug)::INT AS rank,
    sum(priority::DECIMAL(38,12)) OVER (PARTITION BY user_id)::DOUBLE AS total_priority FROM stats QUALIFY rank <= 3)
SELECT user_id, rank, slug, label, priority, priority_is_estimate, total_priority,
  priority / greatest(0.01::DOUBLE, max(priority) OVER (PARTITION BY user_id)) AS bar FROM top""")
def user_study_plan(spark, d):
    return T.user_study_plan(*everybody(spark, d))


TOPIC_VIEWS = "v_attempts v_qtopics v_topics v_questions"


def _rank_sql(key: str, expr: str) -> str:
    return f"""SELECT '{key}' AS sort_key, slug, row_number() OVER (ORDER BY {expr}, slug)::INT AS rank
      FROM stats WHERE total_count > 0"""


@query("topic_rank", TOPIC_VIEWS, STATS_SQL + " UNION ALL ".join([
    _rank_sql("priority", "priority DESC"), _rank_sql("incidence", "primary_count DESC"),
    _rank_sql("recent", "per_exam_recent DESC"), _rank_sql("trend", "trend DESC"),
    _rank_sql("accuracy", "accuracy ASC NULLS LAST")]))
def topic_rank(spark, d):
    return T.all_rankings(pooled_stats(spark, d))


@query("topic_trend", TOPIC_VIEWS, STATS_SQL + """SELECT slug, CASE WHEN trend > 0 THEN printf('+%.2f', trend)
  ELSE printf('%.2f', trend) END AS trend FROM stats""")
def topic_trend(spark, d):
    return pooled_stats(spark, d).select("slug", fx.signed("trend").alias("trend"))


@query("topic_chart", TOPIC_VIEWS, STATS_SQL + """, top AS (SELECT *, row_number() OVER (ORDER BY priority DESC, slug)::INT AS rank
  FROM stats WHERE total_count > 0 QUALIFY rank <= 12)
SELECT rank, slug, label, area, per_exam AS value, per_exam / greatest(1.0::DOUBLE, max(per_exam) OVER ()) AS bar FROM top""")
def topic_chart(spark, d):
    return T.chart_rows(pooled_stats(spark, d))


@query("study_top3", TOPIC_VIEWS, STATS_SQL + """, tot AS (SELECT sum(priority::DECIMAL(38,12))::DOUBLE AS t FROM stats),
  top AS (SELECT *, row_number() OVER (ORDER BY priority DESC, slug)::INT AS rank FROM stats QUALIFY rank <= 3)
SELECT rank, slug, priority, (SELECT t FROM tot) AS total_priority,
  priority / greatest(0.01::DOUBLE, max(priority) OVER ()) AS bar FROM top""")
def study_top3(spark, d):
    return T.study_plan(pooled_stats(spark, d))


@query("topic_year_counts", "v_qtopics", """
WITH c AS (SELECT slug, year, count(*) AS n FROM v_qtopics WHERE tpos = 0 GROUP BY ALL)
SELECT slug, year, n, greatest(max(n) OVER (PARTITION BY slug), 1) AS peak FROM c""")
def topic_year_counts(spark, d):
    return T.topic_years(A.questions(spark, d))


# SQL can't name columns by the data: these are the years that the stand-in items have
EXAM_YEARS = list(range(2002, 2024))


@query("topic_year_matrix", "v_qtopics", "SELECT slug, "
       + ", ".join(f'count(*) FILTER (year = {y}) AS "{y}"' for y in EXAM_YEARS)
       + " FROM v_qtopics WHERE tpos = 0 GROUP BY slug")
def topic_year_matrix(spark, d):
    return T.topic_year_matrix(A.questions(spark, d))


@query("coverage", "v_questions", """
SELECT count(*) FILTER (len(topics) = 0) AS count, count(*) AS total,
  CASE WHEN count(*) = 0 THEN 1.0::DOUBLE ELSE (count(*) - count(*) FILTER (len(topics) = 0)) / count(*) END AS coverage
FROM v_questions""")
def coverage(spark, d):
    return T.coverage(A.questions(spark, d))


@query("topic_report", "v_qtopics v_topics v_questions", """
WITH c AS (SELECT slug, count(*) FILTER (tpos = 0) AS p, count(*) AS a FROM v_qtopics GROUP BY slug)
SELECT slug, label, coalesce(p, 0) AS primary_count, coalesce(a, 0) AS any_count,
  100 * coalesce(p, 0) / (SELECT count(*) FROM v_questions) AS pct_exam
FROM v_topics LEFT JOIN c USING (slug)""")
def topic_report(spark, d):
    return T.topic_report(A.questions(spark, d), A.topics(spark, d))


@query("untagged_items", "v_questions", "SELECT question_id, area FROM v_questions WHERE len(topics) = 0")
def untagged_items(spark, d):
    return A.questions(spark, d).filter(F.size("topics") == 0).select("question_id", "area")


# selections: one per brand family (the digit a brand ends in), plus every type
@query("topic_pool", "v_qtopics v_topics", """
WITH sel AS (SELECT CASE WHEN contains(slug, '#') THEN right(slug, 1) ELSE slug END AS selection_id, slug FROM v_topics)
SELECT selection_id, count(DISTINCT question_id) AS pool FROM v_qtopics JOIN sel USING (slug) GROUP BY selection_id""")
def topic_pool(spark, d):
    sel = A.topics(spark, d).select(
        F.when(F.col("slug").contains("#"), F.substring("slug", -1, 1)).otherwise(F.col("slug")).alias("selection_id"),
        "slug",
    )
    return T.topic_pool(A.questions(spark, d), sel)


@query("topic_bucket", "v_questions", """
SELECT question_id, list_filter(topics, lambda t: t IN ('PROMO', 'Brand#2', 'Brand#12'))[1] AS bucket
FROM v_questions WHERE list_has_any(topics, ['PROMO', 'Brand#2', 'Brand#12'])""")
def topic_bucket(spark, d):
    return T.topic_bucket(A.questions(spark, d), ["PROMO", "Brand#2", "Brand#12"])


# ---------------------------------------------------------------- sessions

GRADED_COLS = "user_id, session_id, pos, question_id, response, answer, annulled, correct, seconds"


@query("session_review", "v_graded", f"SELECT {GRADED_COLS} FROM v_graded")
def session_review(spark, d):
    return graded(spark, d).select(*GRADED_COLS.split(", "))


@query("is_correct", "v_graded", """
SELECT annulled, response IS NULL AS blank, correct, count(*) AS n FROM v_graded GROUP BY ALL""")
def is_correct(spark, d):
    return graded(spark, d).groupBy("annulled", F.col("response").isNull().alias("blank"), "correct").agg(
        F.count("*").alias("n")
    )


SCORE_SQL = """SELECT user_id, session_id, count(*) AS total, count(response) AS answered,
  count(*) FILTER (correct) AS correct FROM v_graded GROUP BY ALL"""


@query("score_session", "v_graded v_sessions", f"""
SELECT *, answered - correct AS incorrect, total - answered AS blank FROM (SELECT s.user_id, session_id,
  coalesce(total, 0) AS total, coalesce(answered, 0) AS answered, coalesce(correct, 0) AS correct
  FROM v_sessions s LEFT JOIN ({SCORE_SQL}) USING (session_id))""")
def score_session(spark, d):
    graded_items = S.grade(A.items(spark, d), A.questions(spark, d), "left")
    return S.score_sessions(graded_items, sessions=A.sessions(spark, d))


@query("score_by_area", "v_graded", """
SELECT user_id, session_id, area, count(*) AS total, count(*) FILTER (correct) AS correct FROM v_graded GROUP BY ALL""")
def score_by_area(spark, d):
    return S.score_by_area(graded(spark, d))


@query("score_by_topic", "v_graded", """
SELECT *, correct / total AS rate FROM (SELECT user_id, session_id, topics[1] AS slug, count(*) AS total,
  count(*) FILTER (correct) AS correct FROM v_graded WHERE len(topics) > 0 GROUP BY ALL) WHERE correct < total""")
def score_by_topic(spark, d):
    return S.score_by_topic(graded(spark, d))


ACC_SQL = """SELECT {by}, total, correct, floor(100 * (correct / total) + 0.5::DOUBLE)::BIGINT AS pct FROM (
  SELECT {by}, count(*) AS total, count(*) FILTER (correct) AS correct
  FROM v_latest JOIN v_questions USING (question_id) GROUP BY ALL)"""


def _accuracy(by):
    return lambda spark, d: H.accuracy(H.latest_attempt(A.attempts(spark, d)), A.questions(spark, d), by)


query("overall_accuracy", "v_latest v_questions", ACC_SQL.format(by="user_id"))(_accuracy(("user_id",)))
query("accuracy_by_area", "v_latest v_questions", ACC_SQL.format(by="user_id, area"))(_accuracy(("user_id", "area")))
query("accuracy_by_year", "v_latest v_questions", ACC_SQL.format(by="user_id, year"))(_accuracy(("user_id", "year")))


@query("most_wrong", "v_attempts v_questions", """
SELECT user_id, question_id, wrong, row_number() OVER (PARTITION BY user_id ORDER BY wrong DESC, f, question_id)::INT AS rank
FROM (SELECT user_id, question_id, count(*) AS wrong, min((timestamp, seq)) AS f
  FROM v_attempts SEMI JOIN v_questions USING (question_id) WHERE NOT correct GROUP BY ALL) QUALIFY rank <= 10""")
def most_wrong(spark, d):
    return H.most_wrong(A.attempts(spark, d), A.questions(spark, d))


EVOLUTION_SQL = f"""WITH sc AS ({SCORE_SQL}),
  ev AS (SELECT s.user_id, session_id, finished_at, strftime(make_timestamp(finished_at * 1000), '%d/%m/%Y') AS date,
    CASE WHEN total > 0 THEN floor(100 * (correct / total) + 0.5::DOUBLE)::BIGINT ELSE 0 END AS pct, label, elapsed_seconds
  FROM v_sessions s LEFT JOIN sc USING (session_id) WHERE finished_at IS NOT NULL)
"""


@query("evolution", "v_graded v_sessions", EVOLUTION_SQL + "SELECT * EXCLUDE (elapsed_seconds) FROM ev")
def evolution(spark, d):
    return H.evolution(A.sessions(spark, d), S.score_sessions(S.grade(A.items(spark, d), A.questions(spark, d), "left")))


@query("history", "v_graded v_sessions", EVOLUTION_SQL + """
SELECT * EXCLUDE (elapsed_seconds), CASE WHEN elapsed_seconds >= 3600
  THEN printf('%dh%02dmin', elapsed_seconds // 3600, elapsed_seconds % 3600 // 60)
  ELSE printf('%dmin', elapsed_seconds // 60) END AS duration FROM ev""")
def history(spark, d):
    scores = S.score_sessions(S.grade(A.items(spark, d), A.questions(spark, d), "left"))
    return H.history_table(A.sessions(spark, d), scores)


PACE_SQL = """SELECT user_id, session_id, count(*) AS measured, sum(seconds) AS total_seconds,
  sum(seconds) / count(*) AS avg_seconds,
  sum(seconds) FILTER (correct) / count(*) FILTER (correct) AS avg_correct,
  sum(seconds) FILTER (NOT correct) / count(*) FILTER (NOT correct) AS avg_incorrect
FROM v_graded WHERE seconds > 0 GROUP BY ALL"""


@query("pacing", "v_graded", PACE_SQL)
def pacing(spark, d):
    return S.pacing(graded(spark, d))


@query("pacing_alert", "v_graded", f"""
SELECT user_id, session_id, floor((avg_incorrect / avg_correct - 1) * 100 + 0.5::DOUBLE)::BIGINT AS pct_more
FROM ({PACE_SQL}) WHERE avg_incorrect > avg_correct * 1.2::DOUBLE AND avg_incorrect - avg_correct >= 60""")
def pacing_alert(spark, d):
    return S.pacing_alert(S.pacing(graded(spark, d)))


@query("slowest_items", "v_graded", """
SELECT user_id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY seconds DESC, pos)::INT AS rank,
  question_id, seconds, correct FROM v_graded WHERE seconds > 0 QUALIFY rank <= 5""")
def slowest_items(spark, d):
    return S.slowest_items(graded(spark, d))


# absences stand-in: 0-5 absences per order, lengths from the order's price
@query("absences", "", """
WITH s AS (SELECT o_custkey AS user_id, o_orderkey AS session_id,
  list_transform(range(1, o_orderkey % 6 + 1), lambda i: ((floor(o_totalprice)::BIGINT * i) % 53 + 1)::INT) AS a FROM orders)
SELECT user_id, session_id, len(a)::INT AS count, coalesce(list_max(a), 0)::INT AS longest_seconds,
  len(list_filter(a, lambda x: x > 30))::INT AS over_limit,
  len(list_filter(a, lambda x: x > 30)) > 0 OR len(a) >= 3 AS would_be_flagged FROM s""")
def absences(spark, d):
    o = A.table(spark, d, "orders")
    n = (F.col("o_orderkey") % 6).cast("int")
    price = F.floor("o_totalprice")
    lengths = F.transform(
        F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")),
        lambda i: ((price * i) % 53 + 1).cast("int"),
    )
    return S.absence_summary(
        o.select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("session_id"), lengths.alias("absences"))
    )


@query("session_counters", "v_items v_sessions", """
SELECT s.user_id, session_id, count(response) AS answered, count(pos) - count(response) AS blank,
  count(*) FILTER (flagged) AS flagged, any_value(s.time_limit_seconds) - any_value(elapsed_seconds) AS remaining
FROM v_sessions s LEFT JOIN v_raw_items i USING (session_id) GROUP BY ALL""")
def session_counters(spark, d):
    return S.session_counters(A.sessions(spark, d), A.raw_items(spark, d))


@query("pace_delta", "v_items v_sessions", """
WITH t AS (SELECT s.user_id, session_id, any_value(s.time_limit_seconds) / nullif(count(pos), 0) AS target,
    any_value(elapsed_seconds) AS el, count(response) AS ans
  FROM v_sessions s LEFT JOIN v_raw_items i USING (session_id) GROUP BY ALL),
  x AS (SELECT *, el - ans * target AS delta, floor(abs(el - ans * target) / 60 + 0.5::DOUBLE)::BIGINT AS m FROM t)
SELECT user_id, session_id, target, delta, CASE WHEN abs(delta) < 120 THEN 'no ritmo'
  WHEN delta > 0 THEN CASE WHEN m < 1 THEN 'menos de 1 min' ELSE m || ' min' END || ' atrasado'
  WHEN delta <= 0 THEN CASE WHEN m < 1 THEN 'menos de 1 min' ELSE m || ' min' END || ' adiantado' END AS label FROM x""")
def pace_delta(spark, d):
    return S.pace_deltas(A.sessions(spark, d), A.raw_items(spark, d))


@query("attempt_rows", "v_graded", """
SELECT user_id, session_id, pos, question_id, finished_at AS timestamp, response AS answer, correct,
  coalesce(seconds, 0) AS seconds_spent FROM v_graded WHERE finished_at IS NOT NULL""")
def attempt_rows(spark, d):
    return S.attempt_rows(graded(spark, d))


# scratch stand-in: the tax digits play the part of the typed text and drawing
SCRATCH_SQL = """SELECT l_orderkey AS session_id, l_partkey AS question_id,
  CASE WHEN l_tax > 0.05::DOUBLE THEN l_returnflag ELSE '  ' END AS text,
  CASE WHEN l_discount < 0.02::DOUBLE THEN 'png' ELSE '' END AS drawing FROM lineitem"""


def scratch(spark, d):
    li = A.table(spark, d, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("session_id"),
        F.col("l_partkey").alias("question_id"),
        F.when(F.col("l_tax") > 0.05, F.col("l_returnflag")).otherwise(F.lit("  ")).alias("text"),
        F.when(F.col("l_discount") < 0.02, F.lit("png")).otherwise(F.lit("")).alias("drawing"),
    )


@query("item_status", "v_items", f"""
WITH sc AS (SELECT DISTINCT session_id, question_id FROM ({SCRATCH_SQL})
  WHERE length(trim(text)) > 0 OR length(drawing) > 0)
SELECT user_id, session_id, pos, question_id, response IS NOT NULL AS answered, flagged,
  (session_id, question_id) IN (SELECT (session_id, question_id) FROM sc) AS scratched FROM v_items""")
def item_status(spark, d):
    return S.item_status(A.items(spark, d), scratch(spark, d))


@query("triage", "v_items v_questions v_marks", """
SELECT user_id, i.session_id, pos, question_id, reason, resolved_at IS NULL AS still_open
FROM v_items i SEMI JOIN v_questions USING (question_id) JOIN v_marks m USING (user_id, question_id)
WHERE flagged OR resolved_at IS NULL""")
def triage(spark, d):
    return S.triage(A.items(spark, d), A.questions(spark, d), A.marks(spark, d))


# ---------------------------------------------------------------- attempts and filters


def _latest(tie, keys="user_id, question_id"):
    cols = "user_id, question_id, session_id, timestamp, answer, correct, seconds_spent"
    op = "DESC" if tie == "last" else "ASC"
    return f"""SELECT {cols} FROM v_attempts
      QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY timestamp DESC, seq {op}) = 1"""


LATEST_COLS = ["user_id", "question_id", "session_id", "timestamp", "answer", "correct", "seconds_spent"]


@query("latest_attempt", "v_attempts", _latest("last"))
def latest_attempt(spark, d):
    return H.latest_attempt(A.attempts(spark, d)).select(*LATEST_COLS)


@query("latest_attempt_first_wins", "v_attempts", _latest("first", "question_id"))
def latest_attempt_first_wins(spark, d):
    return H.latest_attempt(A.attempts(spark, d), ("question_id",), "first").select(*LATEST_COLS)


@query("last_seen", "v_attempts", "SELECT user_id, question_id, max(timestamp) AS last_seen FROM v_attempts GROUP BY ALL")
def last_seen(spark, d):
    return H.last_seen(A.attempts(spark, d))


@query("by_year", "v_questions", """
SELECT year, question_id, number, row_number() OVER (PARTITION BY year ORDER BY number, bank_pos)::INT AS pos
FROM v_questions""")
def by_year(spark, d):
    from ..operators import sampling as K

    return K.by_year(A.questions(spark, d))


@query("sessions_open", "v_sessions", """
SELECT user_id, session_id, mode, label, created_at FROM v_sessions WHERE finished_at IS NULL""")
def sessions_open(spark, d):
    return A.sessions(spark, d).filter("finished_at is null").select("user_id", "session_id", "mode", "label", "created_at")


@query("sessions_finished", "v_sessions", """
SELECT user_id, session_id, finished_at FROM v_sessions WHERE finished_at IS NOT NULL ORDER BY finished_at DESC, session_id""")
def sessions_finished(spark, d):
    return (
        A.sessions(spark, d)
        .filter("finished_at is not null")
        .select("user_id", "session_id", "finished_at")
        .orderBy(F.desc("finished_at"), "session_id")
    )


@query("area_for", "v_questions", """
SELECT year, number, CASE
  WHEN number BETWEEN 1 AND 20 THEN 'matematica'
  WHEN number BETWEEN 21 AND CASE WHEN year <= 2007 THEN 40 ELSE 50 END THEN 'fundamentos'
  WHEN number BETWEEN 21 AND 70 THEN 'tecnologia' ELSE 'desconhecida' END AS area, count(*) AS n
FROM (SELECT year, number + 3 AS number FROM v_questions) GROUP BY ALL""")
def area_for(spark, d):
    shifted = A.questions(spark, d).select("year", (F.col("number") + 3).alias("number"))
    return shifted.groupBy("year", "number", fx.area_for("number", "year").alias("area")).agg(F.count("*").alias("n"))


@query("item_ids", "v_questions", """
SELECT question_id, printf('%d-%02d', year, number) AS item_id,
  printf('%d/q%02d.webp', year, number) AS image FROM v_questions""")
def item_ids(spark, d):
    return A.questions(spark, d).select(
        "question_id",
        fx.item_id("year", "number").alias("item_id"),
        F.regexp_replace(fx.image_path("year", "number"), "^questions/", "").alias("image"),
    )


@query("labels_join", "v_qtopics v_topics v_marks v_questions", """
SELECT question_id, slug, coalesce(t.label, slug) AS topic_label,
  CASE q.area WHEN 'matematica' THEN 'Matematica' WHEN 'fundamentos' THEN 'Fundamentos'
    WHEN 'tecnologia' THEN 'Tecnologia' ELSE '-' END AS area_label
FROM v_qtopics q LEFT JOIN v_topics t USING (slug)""")
def labels_join(spark, d):
    labels = A.topics(spark, d).select("slug", "label")
    rows = T.topic_rows(A.questions(spark, d))
    return rows.join(labels, "slug", "left").select(
        "question_id", "slug", F.coalesce("label", "slug").alias("topic_label"),
        fx.label_of("area", fx.AREA_LABELS).alias("area_label"),
    )


@query("items_per_year", "v_questions", "SELECT year, count(*) AS n FROM v_questions GROUP BY year")
def items_per_year(spark, d):
    return A.questions(spark, d).groupBy("year").agg(F.count("*").alias("n"))


@query("not_yet_correct", "v_questions v_attempts", """
SELECT DISTINCT user_id, question_id FROM v_attempts SEMI JOIN v_questions USING (question_id)
WHERE (user_id, question_id) NOT IN (SELECT (user_id, question_id) FROM v_attempts WHERE correct)""")
def not_yet_correct(spark, d):
    a = A.attempts(spark, d)
    met = a.groupBy("user_id", "question_id").agg(F.bool_or("correct").alias("hit"))
    return met.filter("not hit").join(A.questions(spark, d).select("question_id"), "question_id", "left_semi").drop("hit")


@query("scalar_suite", "v_graded v_sessions", f"""
WITH x AS (SELECT session_id, question_id, pos, seconds, elapsed_seconds AS e, s.finished_at AS fin, g.topics,
    s.label, floor(seconds + 0.5::DOUBLE)::BIGINT AS sr
  FROM v_graded g JOIN v_sessions s USING (session_id))
SELECT session_id, question_id, pos,
  printf('%02d:%02d:%02d', e // 3600, e % 3600 // 60, e % 60) AS clock,
  CASE WHEN e < 60 THEN printf('%ds', e) WHEN e >= 3600 THEN printf('%dh%02dmin', e // 3600, e % 3600 // 60)
    ELSE printf('%dmin', e // 60) END AS duration,
  CASE WHEN sr >= 60 THEN printf('%dmin%02ds', sr // 60, sr % 60) ELSE printf('%ds', sr) END AS pace,
  CASE WHEN floor(({NOW} - fin) / 86400000) <= 0 THEN 'hoje' WHEN floor(({NOW} - fin) / 86400000) = 1 THEN 'ontem'
    WHEN fin IS NOT NULL THEN printf('ha %d dias', floor(({NOW} - fin) / 86400000)::BIGINT) END AS age,
  greatest(0, ceil((fin - {NOW}) / 86400000)::BIGINT) AS days_until,
  upper(trim(label)) AS label_up, lpad(pos::VARCHAR, 3, '0') AS padded, len(topics)::INT AS n_topics,
  coalesce(list_contains(topics, 'PROMO'), FALSE) AS has_promo, array_to_string(list_sort(topics[1:2]), '+') AS topic_key,
  strftime(make_timestamp(fin * 1000), '%Y-%m-%d') AS iso_date, starts_with(label, 'Prova 1') AS starts,
  ends_with(label, '7') AS ends
FROM x""")
def scalar_suite(spark, d):
    s = A.sessions(spark, d).select("session_id", F.col("elapsed_seconds").alias("e"), "label")
    g = graded(spark, d).join(s, "session_id")
    age = F.when(F.col("finished_at").isNotNull(), fx.age("finished_at", A.NOW))
    return g.select(
        "session_id", "question_id", "pos",
        fx.clock("e").alias("clock"), fx.duration("e").alias("duration"), fx.pace("seconds").alias("pace"),
        age.alias("age"), fx.days_until("finished_at", A.NOW).alias("days_until"),
        F.upper(F.trim("label")).alias("label_up"), F.lpad(F.col("pos").cast("string"), 3, "0").alias("padded"),
        F.size("topics").alias("n_topics"), F.array_contains("topics", "PROMO").alias("has_promo"),
        F.concat_ws("+", F.array_sort(F.slice("topics", 1, 2))).alias("topic_key"),
        fx.local_date("finished_at", "yyyy-MM-dd").alias("iso_date"),
        F.startswith("label", F.lit("Prova 1")).alias("starts"), F.endswith("label", F.lit("7")).alias("ends"),
    )
