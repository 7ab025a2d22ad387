"""Cases in which size, order of sessions, unknown items or nested patterns once changed a result."""

import random
import re

from pyspark.sql import functions as F

from examloom.functions import text as X
from examloom.operators import answerkey, marks, schedule, scoring

OUT = "u long, t long, seq long, q int"


def test_schedules_do_not_depend_on_the_group_limit(spark):
    rng = random.Random(4)
    histories = [[3, 3, 3, 4, 5], *([rng.randint(0, 5) for _ in range(rng.randint(4, 14))] for _ in range(400))]
    rows = [(u, k * 90_000_000, k, q) for u, h in enumerate(histories) for k, q in enumerate(h)]
    df = spark.createDataFrame(rows, OUT)
    short = schedule.rebuild(df, ["u"]).collect()
    long = schedule.rebuild(df, ["u"], max_group=3).collect()
    assert sorted(map(tuple, short)) == sorted(map(tuple, long))


def test_mark_replay_keeps_the_reason_of_a_note_edit(spark):
    log = [(1, 1, "mark", "erro", 7, 10, 0), (1, 1, "edit", None, None, 20, 1), (1, 1, "toggle", None, None, 30, 2)]
    df = spark.createDataFrame(
        log, "user_id long, question_id long, action string, reason string, session_id long, at long, seq long"
    )
    a, b = (marks.replay(df, n).select("reason", "times_marked", "updated_at", "resolved_at").collect() for n in (100, 1))
    assert a == b and a[0].reason == "erro"


def test_sessions_of_a_batch_follow_each_other(spark):
    state = "user_id long, question_id long, repetitions long, interval_days double, ease_factor double, due_at long, last_reviewed_at long"
    old = spark.createDataFrame([(1, 2, 3, 15.0, 2.5, 99, 9)], state)
    new = spark.createDataFrame([(1, 1, 100, 1, 4), (1, 1, 200, 2, 4)], "user_id long, question_id long, t long, seq long, q int")
    got = {r.question_id: r for r in schedule.apply_outcomes(old, new, ["user_id", "question_id"]).collect()}
    assert (got[1].repetitions, got[1].interval_days, got[1].last_reviewed_at) == (2, 6.0, 200)
    assert tuple(got[2]) == (1, 2, 3, 15.0, 2.5, 99, 9)
    later = spark.createDataFrame([(1, 2, 300, 1, 4)], new.schema)
    got = schedule.apply_outcomes(old, later, ["user_id", "question_id"]).collect()
    assert len(got) == 1 and (got[0].repetitions, got[0].interval_days) == (4, 38.0)


def test_due_items_are_those_of_the_bank(spark):
    srs = spark.createDataFrame([(1, k, 5) for k in (3, 8, 9)], "user_id long, question_id long, due_at long")
    bank = spark.createDataFrame([(9, 1), (3, 2)], "question_id long, bank_pos long")
    got = schedule.due(srs, 10, bank=bank).orderBy("rank").collect()
    assert [(r.question_id, r.due_total) for r in got] == [(9, 2), (3, 2)]


def test_a_key_without_any_expected_number_is_kept(spark):
    keys = spark.createDataFrame([(1, "1. (A)\n2. (B)")], "doc_id long, text string")
    expected = spark.createDataFrame([(1, 70)], "doc_id long, number long")
    best = answerkey.parse_best(keys, expected)
    assert sorted((r.number, r.method, r.overlap) for r in best.collect()) == [(1, "lines", 0), (2, "lines", 0)]
    items = expected.select("doc_id", "number")
    status = {r.number: r.status for r in answerkey.reconcile(items, best).collect()}
    assert status == {1: "extra_answer", 2: "extra_answer", 70: "missing_answer"}


def test_every_match_holds_the_mandatory_literal():
    assert X.mandatory_literal("x((ab)cd)?y") in ("x", "y")
    assert X.mandatory_literal("grafo") == "grafo" and X.mandatory_literal("a|b") == ""
    rng = random.Random(2)

    def pattern(depth=0):
        parts = []
        for _ in range(rng.randint(1, 4)):
            atom = rng.choice(["a", "b", "ab", "cd", "[ab]", "[^a]", r"\w", "."] + (["g", "alt"] if depth < 3 else []))
            if atom == "g":
                atom = f"({rng.choice(['', '?:'])}{pattern(depth + 1)})"
            elif atom == "alt":
                atom = f"({pattern(depth + 1)}|{pattern(depth + 1)})"
            parts.append(atom + rng.choice(["", "", "", "?", "*", "+", "{0,2}", "{2}"]))
        return "".join(parts)

    for _ in range(3000):
        p = pattern()
        need = X.mandatory_literal(p)
        for _ in range(5):
            t = "".join(rng.choice("abcd ") for _ in range(8))
            for m in re.finditer(p, t):
                assert need in m[0], (p, need, m[0])


def test_sessions_without_items_have_rows(spark):
    sessions = spark.createDataFrame([(1, 1, 60, 5), (1, 2, 60, 6)], "user_id long, session_id long, time_limit_seconds long, elapsed_seconds long")
    items = spark.createDataFrame(
        [(1, 1, 9, "A", True, True, False)],
        "user_id long, session_id long, question_id long, response string, known boolean, correct boolean, flagged boolean",
    )
    got = {r.session_id: r for r in scoring.score_sessions(items, sessions=sessions).collect()}
    assert (got[1].total, got[1].correct, got[2].total, got[2].blank) == (1, 1, 0, 0)
    assert {r.session_id: r.blank for r in scoring.session_counters(sessions, items).collect()} == {1: 0, 2: 0}
    pace = {r.session_id: (r.target, r.label) for r in scoring.pace_deltas(sessions, items).collect()}
    assert pace[2] == (None, None) and pace[1][0] == 60
