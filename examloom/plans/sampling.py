"""Exam assembly queries. The oracles pair users with the whole bank; the Spark plans never do."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import core as fx
from ..operators import history as H
from ..operators import marks as R
from ..operators import sampling as K
from ..operators import schedule as N
from ..operators import scoring as S
from ..sources import adapters as A
from .registry import query
from .views import NOW

SEED = "s1"


def users(spark, d):
    return A.sessions(spark, d).select("user_id").distinct()


USERS_SQL = "users AS (SELECT DISTINCT user_id FROM v_sessions)"


def _perm(name: str, src: str, *keys: str) -> str:
    """CTE `name`: every row of `src` (with a column n) and each place of its own permutation: step, place below n."""
    digest = f"sha256(concat_ws(':', '{SEED}', {', '.join(keys)}))"
    ks = "[" + ", ".join(f"(('0x' || substr(h, {8 * r + 1}, 8))::BIGINT & 1073741823)" for r in range(8)) + "]"
    sql = f"""SELECT *, step // b AS x, step % b AS y FROM (SELECT *, unnest(range(a * b)) AS step FROM (
      SELECT *, {ks} AS ks, ceil(n / a)::BIGINT AS b FROM (SELECT *, {digest} AS h, ceil(sqrt(n::DOUBLE))::BIGINT AS a FROM ({src}))))"""
    for r in range(8):
        to, by, size = ("x", "y", "a") if r % 2 == 0 else ("y", "x", "b")
        mixed = f"(({by} + ks[{r + 1}]) * ({by} + ks[{r + 1}]) % 2147483647 * 48271 % 2147483647)"
        sql = f"SELECT * REPLACE (({to} + {mixed}) % {size} AS {to}) FROM ({sql})"
    return f"{name} AS (SELECT * EXCLUDE (h, a, b, ks, x, y), x * b + y AS place FROM ({sql}) WHERE x * b + y < n)"


@query("exam_year", "v_questions", """
SELECT year, row_number() OVER (PARTITION BY year ORDER BY number, bank_pos)::INT AS pos, question_id,
  'Prova ' || year AS label FROM v_questions""")
def exam_year(spark, d):
    return K.by_year(A.questions(spark, d)).select(
        "year", "pos", "question_id", F.concat(F.lit("Prova "), F.col("year").cast("string")).alias("label")
    )


def _ring_sql(src, strata):
    return f"""SELECT *, row_number() OVER (PARTITION BY {strata} ORDER BY md5(concat_ws(':', '{SEED}', question_id)), question_id) - 1 AS place,
      count(*) OVER (PARTITION BY {strata}) AS n FROM ({src})"""


def _shuffle(alias="pos"):
    return f"row_number() OVER (PARTITION BY user_id ORDER BY md5(concat_ws(':', '{SEED}', user_id, question_id)), question_id)::INT AS {alias}"


@query("exam_random", "v_questions v_attempts v_sessions", f"""
WITH {USERS_SQL}, hit AS (SELECT DISTINCT user_id, question_id FROM v_attempts WHERE correct),
  rng AS ({_ring_sql("SELECT question_id, area FROM v_questions WHERE NOT annulled", "area")}),
  {_perm("perm", "SELECT user_id, area, n FROM users CROSS JOIN (SELECT DISTINCT area, n FROM rng)", "user_id", "area")},
  c AS (SELECT user_id, question_id, area, row_number() OVER (PARTITION BY user_id, area ORDER BY step) AS r
    FROM perm JOIN rng USING (area, place) ANTI JOIN hit USING (user_id, question_id)
    QUALIFY r <= CASE area WHEN 'matematica' THEN 20 WHEN 'fundamentos' THEN 30 WHEN 'tecnologia' THEN 20 ELSE 0 END)
SELECT user_id, {_shuffle()}, question_id, area, 'Simulado aleatorio (70q)' AS label FROM c""")
def exam_random(spark, d):
    return K.random_exam(users(spark, d), A.questions(spark, d), A.attempts(spark, d), SEED)


AREAS = ["matematica", "tecnologia"]


def _area_sql(annulled: str, anti: str) -> str:
    return f"""
WITH {USERS_SQL}, hit AS (SELECT DISTINCT user_id, question_id FROM v_attempts WHERE correct),
  rng AS ({_ring_sql(f"SELECT question_id, 'all' AS pool FROM v_questions WHERE {annulled} area IN ('matematica', 'tecnologia')", "pool")}),
  {_perm("perm", "SELECT user_id, pool, n FROM users CROSS JOIN (SELECT DISTINCT pool, n FROM rng)", "user_id", "pool")},
  c AS (SELECT user_id, question_id, row_number() OVER (PARTITION BY user_id ORDER BY step) AS r
    FROM perm JOIN rng USING (pool, place) {anti} QUALIFY r <= 20)
SELECT user_id, {_shuffle()}, question_id, 'Pratica: matematica, tecnologia (' || count(*) OVER (PARTITION BY user_id) || 'q)' AS label FROM c"""


@query("exam_area", "v_questions v_attempts v_sessions", _area_sql("NOT annulled AND", "ANTI JOIN hit USING (user_id, question_id)"))
def exam_area(spark, d):
    return K.area_exam(users(spark, d), A.questions(spark, d), A.attempts(spark, d), AREAS, 20, SEED)


# both switches off: annulled and already correct items take part
@query("exam_area_open", "v_questions v_attempts v_sessions", _area_sql("", ""))
def exam_area_open(spark, d):
    args = users(spark, d), A.questions(spark, d), A.attempts(spark, d), AREAS, 20, SEED
    return K.area_exam(*args, exclude_annulled=False, exclude_correct=False)


@query("quota_sample", "v_questions", f"""
SELECT area, question_id, row_number() OVER (PARTITION BY area ORDER BY md5(concat_ws(':', '{SEED}', question_id)))::INT AS rank
FROM v_questions QUALIFY rank <= CASE area WHEN 'matematica' THEN 20 WHEN 'fundamentos' THEN 30 WHEN 'tecnologia' THEN 20 ELSE 0 END""")
def quota_sample(spark, d):
    return K.quota_sample(A.questions(spark, d), SEED)


@query("round_robin", "v_attempts v_questions", f"""
WITH r AS (SELECT user_id, topics[1] AS slug, question_id,
    row_number() OVER (PARTITION BY user_id, topics[1] ORDER BY max(timestamp) DESC, question_id) AS rank,
    md5(concat_ws(':', '{SEED}', user_id, topics[1])) AS gp
  FROM v_attempts JOIN v_questions USING (question_id) WHERE len(topics) > 0 GROUP BY user_id, topics, question_id)
SELECT user_id, slug, question_id, row_number() OVER (PARTITION BY user_id ORDER BY rank, gp)::INT AS pos
FROM r QUALIFY pos <= 20""")
def round_robin(spark, d):
    from pyspark.sql import Window as W

    q = A.questions(spark, d).select("question_id", S.primary().alias("slug")).filter("slug is not null")
    met = H.last_seen(A.attempts(spark, d)).join(q, "question_id")
    w = W.partitionBy("user_id", "slug").orderBy(F.desc("last_seen"), "question_id")
    ranked = met.withColumn("rank", F.row_number().over(w)).withColumn(
        "group_pos", fx.hash_order(SEED, "user_id", "slug")
    )
    return K.round_robin(ranked, 20).select("user_id", "slug", "question_id", "pos")


def selections(spark, d):
    """Each user's three topics with most open marks."""
    top = R.marks_by_topic(A.marks(spark, d), A.questions(spark, d)).filter("rank <= 3")
    return top.select("user_id", "slug")


SELECTION_SQL = """sel AS (SELECT user_id, slug FROM (SELECT user_id, topics[1] AS slug, count(*) AS n
    FROM v_marks JOIN v_questions USING (question_id) WHERE resolved_at IS NULL AND len(topics) > 0 GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, slug) <= 3)"""

def _topic_exam_sql(selection: str, annulled: str, anti: str) -> str:
    return f"""
WITH {selection}, hit AS (SELECT DISTINCT user_id, question_id FROM v_attempts WHERE correct),
  rng AS ({_ring_sql(f"SELECT question_id, slug, tpos FROM v_qtopics {annulled}", "slug")}),
  {_perm("perm", "SELECT user_id, slug, n FROM sel JOIN (SELECT DISTINCT slug, n FROM rng) USING (slug)", "user_id", "slug")},
  c AS (SELECT s.user_id, s.slug, r.question_id, s.step FROM perm s JOIN rng r USING (slug, place) {anti}
    WHERE NOT EXISTS (SELECT 1 FROM sel s2 JOIN v_qtopics q2 ON q2.slug = s2.slug
      WHERE s2.user_id = s.user_id AND q2.question_id = r.question_id AND q2.tpos < r.tpos)),
  k AS (SELECT *, row_number() OVER (PARTITION BY user_id, slug ORDER BY step) AS rank FROM c),
  p AS (SELECT user_id, question_id, slug, row_number() OVER (PARTITION BY user_id
    ORDER BY rank, md5(concat_ws(':', '{SEED}', user_id, slug)))::INT AS pos FROM k WHERE rank <= 15 QUALIFY pos <= 15),
  names AS (SELECT user_id, string_agg(label, ', ' ORDER BY slug) AS names, count(*) AS m FROM sel JOIN v_topics USING (slug) GROUP BY ALL)
SELECT user_id, pos, question_id, slug, CASE WHEN m > 1 THEN 'Intercalado: ' ELSE 'Topico: ' END || names || ' ('
  || count(*) OVER (PARTITION BY user_id) || 'q)' AS label FROM p JOIN names USING (user_id)"""


HIT = "ANTI JOIN hit h ON h.user_id = s.user_id AND h.question_id = r.question_id"


@query("exam_topic", "v_marks v_qtopics v_questions v_attempts v_topics", _topic_exam_sql(SELECTION_SQL, "WHERE NOT annulled", ""))
def exam_topic(spark, d):
    return K.topic_exam(selections(spark, d), A.questions(spark, d), 15, SEED, topics=A.topics(spark, d))


# every user also selects one of the type topics, so that items carry two selected topics
@query("exam_topic_overlap", "v_marks v_qtopics v_questions v_attempts v_topics", _topic_exam_sql(
    SELECTION_SQL.replace("sel AS", "sel0 AS") + ", sel AS (SELECT * FROM sel0 UNION SELECT DISTINCT user_id, 'PROMO' FROM sel0)",
    "", HIT).replace("JOIN v_topics USING (slug)", "LEFT JOIN v_topics USING (slug)").replace("string_agg(label,", "string_agg(coalesce(label, slug),"))
def exam_topic_overlap(spark, d):
    sel = selections(spark, d)
    sel = sel.union(sel.select("user_id", F.lit("PROMO"))).distinct()
    return K.topic_exam(
        sel, A.questions(spark, d), 15, SEED, A.attempts(spark, d), A.topics(spark, d), exclude_annulled=False, exclude_correct=True
    )


@query("exam_srs", "v_srs_all v_questions", f"""
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY due_at, question_id)::INT AS pos, question_id,
  'Revisao de questoes (' || least(20, count(*) OVER (PARTITION BY user_id))
  || CASE WHEN count(*) OVER (PARTITION BY user_id) > 20 THEN ' de ' || count(*) OVER (PARTITION BY user_id) ELSE '' END
  || 'q)' AS label FROM v_srs_all SEMI JOIN v_questions USING (question_id) WHERE due_at <= {NOW} QUALIFY pos <= 20""")
def exam_srs(spark, d):
    due = N.due(A.srs_all(spark, d), A.NOW, bank=A.questions(spark, d))
    shown = F.least(F.lit(20).cast("bigint"), "due_total")
    return due.select(
        "user_id", F.col("rank").alias("pos"), "question_id",
        K.truncation_label("Revisao de questoes", shown, "due_total").alias("label"),
    )


CANDIDATE_SQL = f"""due AS (SELECT user_id, slug, due_at, md5(concat_ws(':', '{SEED}', user_id, slug)) AS gp
    FROM v_topic_srs WHERE due_at <= {NOW}),
  seen AS (SELECT user_id, question_id, max(timestamp) AS last_seen FROM v_attempts GROUP BY ALL),
  rng AS ({_ring_sql("SELECT question_id, slug, tpos > 0 AS secondary FROM v_qtopics WHERE NOT annulled", "slug, secondary")}),
  {_perm("perm", "SELECT user_id, slug, gp, secondary, n FROM due JOIN (SELECT DISTINCT slug, secondary, n FROM rng) USING (slug)",
         "user_id", "slug", "secondary")},
  cand AS (SELECT user_id, slug, gp, question_id, secondary, last_seen IS NULL AS unseen,
    row_number() OVER (PARTITION BY user_id, slug ORDER BY secondary, last_seen IS NOT NULL, last_seen,
      CASE WHEN last_seen IS NULL THEN step ELSE 0 END, question_id)::INT AS rank
    FROM perm JOIN rng USING (slug, secondary, place) LEFT JOIN seen USING (user_id, question_id))"""


def due_topics(spark, d):
    # every due topic takes part in the interleave: no cap on topics
    return A.topic_srs(spark, d).filter(F.col("due_at") <= A.NOW).select("user_id", "slug", "due_at")


@query("review_candidates", "v_topic_srs v_qtopics v_attempts", f"""
WITH {CANDIDATE_SQL} SELECT user_id, slug, rank, question_id, secondary, unseen FROM cand""")
def review_candidates(spark, d):
    due = due_topics(spark, d).withColumn("group_pos", fx.hash_order(SEED, "user_id", "slug"))
    return K.review_candidates(due, A.questions(spark, d), H.last_seen(A.attempts(spark, d)), SEED).drop("group_pos")


@query("exam_topic_srs", "v_topic_srs v_qtopics v_attempts v_topics", f"""
WITH {CANDIDATE_SQL}, p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY rank, gp)::INT AS pos, question_id, slug
  FROM cand QUALIFY pos <= 20),
names AS (SELECT user_id, CASE WHEN count(*) <= 2 THEN string_agg(label, ' e ' ORDER BY due_at, slug) ELSE count(*) || ' temas' END AS names
  FROM due JOIN v_topics USING (slug) GROUP BY user_id)
SELECT user_id, pos, question_id, slug, 'Revisao: ' || names || ' (' || count(*) OVER (PARTITION BY user_id) || 'q)' AS label
FROM p JOIN names USING (user_id)""")
def exam_topic_srs(spark, d):
    seen = H.last_seen(A.attempts(spark, d))
    return K.topic_review(due_topics(spark, d), A.questions(spark, d), seen, SEED, topics=A.topics(spark, d))


@query("exam_marked", "v_marks v_questions", """
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at, question_id)::INT AS pos, question_id,
  count(*) OVER (PARTITION BY user_id) AS open_total
FROM v_marks SEMI JOIN v_questions USING (question_id) WHERE resolved_at IS NULL QUALIFY pos <= 20""")
def exam_marked(spark, d):
    return K.marked_exam(A.marks(spark, d), A.questions(spark, d))


@query("exam_session_rows", "v_marks v_questions", """
WITH m AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at, question_id) AS pos, question_id,
    count(*) OVER (PARTITION BY user_id) AS n
  FROM v_marks SEMI JOIN v_questions USING (question_id) WHERE resolved_at IS NULL QUALIFY pos <= 20)
SELECT user_id, md5(concat_ws(':', user_id, 'marked', '946684800000')) AS session_id, 'marked' AS mode,
  'Marcadas (' || count(*) || CASE WHEN n > count(*) THEN ' de ' || n ELSE '' END || 'q)' AS label, 946684800000::BIGINT AS created_at,
  'study' AS correction_mode, 0::BIGINT AS elapsed_seconds,
  string_agg(question_id::VARCHAR, ',' ORDER BY pos) AS question_ids FROM m GROUP BY user_id, n""")
def exam_session_rows(spark, d):
    picked = K.marked_exam(A.marks(spark, d), A.questions(spark, d))
    label = K.truncation_label("Marcadas", F.count("*"), F.max("open_total"))
    s = K.create_sessions(picked, "marked", label, A.NOW, correction="study")
    # new sessions are unfinished and reviews untimed: both columns are always null here
    s = s.drop("finished_at", "time_limit_seconds")
    return s.withColumn("question_ids", F.concat_ws(",", F.col("question_ids").cast("array<string>")))
