"""Scheduling, marks and marked exams on small hand-made tables."""

import pytest
from pyspark.sql import functions as F

from examloom.functions import core as fx
from examloom.functions import sm2
from examloom.operators import marks as R
from examloom.operators import sampling as K
from examloom.operators import schedule as N
from examloom.operators import scoring as S

Q = "question_id STRING, year INT, number INT, area STRING, answer STRING, annulled BOOLEAN, topics ARRAY<STRING>, bank_pos BIGINT"
M = ("user_id BIGINT, question_id STRING, reason STRING, note STRING, session_id STRING, created_at BIGINT, "
     "updated_at BIGINT, resolved_at BIGINT, times_marked BIGINT")
SRS = "user_id BIGINT, question_id STRING, repetitions BIGINT, interval_days DOUBLE, ease_factor DOUBLE, last_reviewed_at BIGINT"


@pytest.fixture(scope="module")
def bank(spark):
    return spark.createDataFrame(
        [("q1", 2019, 1, "matematica", "A", False, ["grafos"], 0), ("q2", 2019, 2, "matematica", "A", False, ["grafos"], 1)], Q)


def graded(spark, bank, items):
    """items: (question_id, response, flagged)"""
    df = spark.createDataFrame(
        [(1, "s1", i, q, r, f, 10.0, 1000, 2000, None) for i, (q, r, f) in enumerate(items)],
        "user_id BIGINT, session_id STRING, pos INT, question_id STRING, response STRING, flagged BOOLEAN, seconds DOUBLE, "
        "created_at BIGINT, finished_at BIGINT, time_limit_seconds INT")
    return S.grade(df, bank)


def mark(question="q1", reason="erro", note="", created=1000, updated=1000, resolved=None, times=1):
    return (1, question, reason, note, "s1", created, updated, resolved, times)


def apply(spark, prev, reason, at, note=None):
    marks = spark.createDataFrame(prev, M)
    row = spark.createDataFrame([(1, "q1", "s2", reason, at, note)],
                                "user_id BIGINT, question_id STRING, session_id STRING, reason STRING, at BIGINT, note STRING")
    return R.apply_marks(marks, row).first()


@pytest.mark.parametrize("correct,seconds,ref,expected", [
    (False, 10, 200, "erro"), (True, 500, 200, "lento"), (True, 100, 200, "chute"), (True, 9999, None, "chute")])
def test_suggested_reason(spark, correct, seconds, ref, expected):
    df = spark.createDataFrame([(correct, seconds, ref)], "c BOOLEAN, s INT, r INT")
    assert df.select(fx.suggest_reason("c", "s", "r").alias("x")).first().x == expected


def test_mark_counter_rules(spark):
    new = apply(spark, [], "erro", 5000)
    assert (new.times_marked, new.created_at, new.resolved_at) == (1, 5000, None)
    again = apply(spark, [mark(reason="chute")], "erro", 7000)
    assert (again.times_marked, again.created_at, again.reason) == (1, 1000, "erro")
    reopened = apply(spark, [mark(resolved=4000)], "erro", 9000)
    assert (reopened.times_marked, reopened.resolved_at) == (2, None)
    assert apply(spark, [mark(note="keep")], "erro", 7000).note == "keep"
    assert apply(spark, [mark(note="keep")], "erro", 7000, "new").note == "new"


def test_resolve_and_undo_do_not_count(spark):
    log = [(1, "q1", "mark", "erro", 1, 1000, 1), (1, "q1", "resolve", None, 1, 5000, 2), (1, "q1", "unresolve", None, 1, 6000, 3)]
    schema = "user_id BIGINT, question_id STRING, action STRING, reason STRING, session_id BIGINT, at BIGINT, seq BIGINT"
    m = R.replay_short(spark.createDataFrame(log, schema)).first()
    assert (m.times_marked, m.resolved_at, m.updated_at) == (1, None, 6000)
    m = R.replay_short(spark.createDataFrame(log[:2], schema)).first()
    assert m.resolved_at == 5000
    assert R.replay_short(spark.createDataFrame(log[1:], schema)).count() == 0


def test_reason_counts_have_zeros(spark):
    r = R.marks_by_reason(spark.createDataFrame([mark("a", "chute"), mark("b", "chute")], M)).first()
    assert (r.erro, r.chute, r.lento, r.duvida) == (0, 2, 0, 0)


def test_marked_exam_oldest_first_capped_without_phantoms(spark, bank):
    marks = spark.createDataFrame(
        [mark("q2", created=500), mark("q1", created=100), mark("ghost", created=1), mark("q0", resolved=5)], M)
    out = K.marked_exam(marks, bank).orderBy("pos").collect()
    assert [r.question_id for r in out] == ["q1", "q2"]
    many = spark.createDataFrame([mark(f"x{i}", created=i) for i in range(5)], M)
    ids = spark.createDataFrame([(f"x{i}",) for i in range(5)], "question_id STRING")
    three = K.marked_exam(many, ids, limit=3)
    assert three.count() == 3 and three.first().open_total == 5
    assert three.limit(1).select(K.truncation_label("Marcadas", F.lit(3), "open_total").alias("l")).first().l == "Marcadas (3 de 5q)"


def test_quality_scale(spark):
    df = spark.createDataFrame([(True, False), (True, True), (False, False)], "c BOOLEAN, u BOOLEAN")
    assert [r.q for r in df.select(sm2.quality_from_outcome("c", "u").alias("q")).collect()] == [4, 3, 1]


def test_flagged_hit_returns_sooner_and_blank_is_ignored(spark, bank):
    none = spark.createDataFrame([], SRS)
    plain = N.srs_updates(graded(spark, bank, [("q1", "A", False)]), none).first()
    flagged = N.srs_updates(graded(spark, bank, [("q1", "A", True)]), none).first()
    assert flagged.ease_factor < plain.ease_factor and plain.interval_days == 1
    assert N.srs_updates(graded(spark, bank, [("q1", None, False)]), none).count() == 0
    assert N.topic_tally(graded(spark, bank, [("q1", None, False)])).count() == 0


def test_flagged_hit_does_not_count_for_the_topic(spark, bank):
    none = spark.createDataFrame([], "user_id BIGINT, slug STRING, repetitions BIGINT, interval_days DOUBLE, ease_factor DOUBLE, last_reviewed_at BIGINT")
    g = graded(spark, bank, [("q1", "A", False), ("q2", "A", True)])
    assert N.topic_srs_updates(N.topic_tally(g), none).first().last_accuracy == 0.5


def test_lapse_restarts_and_fold_equals_single_steps(spark, bank):
    outcomes = [(1, "q1", t, t, q) for t, q in enumerate([4, 4, 3, 1, 4, 4, 4, 0, 3])]
    df = spark.createDataFrame(outcomes, "user_id BIGINT, question_id STRING, t BIGINT, seq BIGINT, q INT")
    state = (0, 1.0, 2.5)
    for *_, q in outcomes:
        reps, interval, ease = state
        ease = max(1.3, ease + (0.1 - (5.0 - q) * (0.08 + (5.0 - q) * 0.02)))
        if q < 3:
            state = (0, 1.0, ease)
        else:
            state = (reps + 1, 1.0 if reps == 0 else 6.0 if reps == 1 else float(int(interval * ease + 0.5)), ease)
    r = N.rebuild(df, ["user_id", "question_id"]).first()
    assert (r.repetitions, r.interval_days, r.ease_factor) == state
    lapse = N.rebuild(df.filter("t <= 3"), ["user_id", "question_id"]).first()
    assert (lapse.repetitions, lapse.interval_days) == (0, 1.0)


def test_annulled_blank_counts_as_correct_only(spark):
    bank = spark.createDataFrame([("q1", 2019, 1, "matematica", "A", True, ["x"], 0)], Q)
    df = spark.createDataFrame(
        [(1, "s", 0, "q1", None, False, 0.0, 1, 2, None), (1, "s", 1, "ghost", "A", False, 0.0, 1, 2, None)],
        "user_id BIGINT, session_id STRING, pos INT, question_id STRING, response STRING, flagged BOOLEAN, seconds DOUBLE, "
        "created_at BIGINT, finished_at BIGINT, time_limit_seconds INT")
    r = S.score_sessions(S.grade(df, bank, "left")).first()
    assert (r.total, r.answered, r.correct, r.incorrect, r.blank) == (2, 0, 1, -1, 2)


def test_session_documents_explode_to_items(spark):
    doc = spark.createDataFrame(
        [(1, "s", ["a", "b"], {"a": "A"}, {"b": True}, {"a": 3.0}, 1, None, None)],
        "user_id BIGINT, session_id STRING, question_ids ARRAY<STRING>, responses MAP<STRING,STRING>, flagged MAP<STRING,BOOLEAN>, "
        "time_per_question MAP<STRING,DOUBLE>, created_at BIGINT, finished_at BIGINT, time_limit_seconds INT")
    rows = [(r.pos, r.question_id, r.response, r.flagged, r.seconds) for r in S.session_items(doc).orderBy("pos").collect()]
    assert rows == [(0, "a", "A", False, 3.0), (1, "b", None, True, 0.0)]


def test_round_robin_equals_queue_loop(spark):
    groups = {0: ["a1", "a2", "a3", "a4"], 1: ["b1"], 2: ["c1", "c2"]}
    rows = [(1, g, i + 1, q) for g, qs in groups.items() for i, q in enumerate(qs)]
    df = spark.createDataFrame(rows, "user_id BIGINT, group_pos INT, rank INT, question_id STRING")
    for limit in (3, 5, 20):
        queues, want, served = [list(q) for q in groups.values()], [], True
        while len(want) < limit and served:
            served = False
            for q in queues:
                if len(want) < limit and q:
                    want.append(q.pop(0))
                    served = True
        got = [r.question_id for r in K.round_robin(df, limit).orderBy("pos").collect()]
        assert got == want


def test_topic_review_may_repeat_unless_deduped(spark):
    c = spark.createDataFrame([(1, "g", 1, 1, "q1"), (1, "h", 2, 1, "q1"), (1, "h", 2, 2, "q2")],
                              "user_id BIGINT, slug STRING, group_pos INT, rank INT, question_id STRING")
    assert [r.question_id for r in K.topic_review_exam(c).orderBy("pos").collect()] == ["q1", "q1", "q2"]
    assert [r.question_id for r in K.topic_review_exam(c, dedupe=True).orderBy("pos").collect()] == ["q1", "q2"]


def test_picks_are_exact_when_most_of_the_bank_is_excluded(spark):
    bank = spark.range(200).select(F.col("id").alias("question_id"), F.lit("x").alias("area"))
    users = spark.range(5).select(F.col("id").alias("user_id"), F.lit("x").alias("area"), F.lit(10).cast("bigint").alias("need"))
    excluded = spark.range(5).crossJoin(spark.range(200).filter("id % 10 > 0")).toDF("user_id", "question_id")
    got = K.pick(users, bank, ["area"], "s", excluded)
    per = {r.user_id: r.n for r in got.groupBy("user_id").agg(F.count_distinct("question_id").alias("n")).collect()}
    assert per == {u: 10 for u in range(5)}
    assert got.filter("question_id % 10 > 0").count() == 0
