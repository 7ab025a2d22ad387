"""Device merges, snapshot documents, side files, bank documents."""

import json

import pytest
from pyspark.sql import functions as F

from examloom.operators import merge as M
from examloom.sources import bank as B
from examloom.sources import sidefiles, snapshots

SES = "user_id BIGINT, session_id STRING, label STRING, created_at BIGINT, finished_at BIGINT, updated_at BIGINT, device_rank INT"


def sessions(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], SES)


def tombs(spark, rows=()):
    return spark.createDataFrame([(1, *r) for r in rows], "user_id BIGINT, session_id STRING, deleted_at BIGINT")


def test_both_sides_kept_and_newer_wins_in_either_order(spark):
    none = tombs(spark)
    for a, b in ((0, 1), (1, 0)):
        rows = [("s", "old", 1, None, 1000, a), ("s", "new", 1, None, 9000, b), ("only", "x", 1, None, 5, a)]
        got = {r.session_id: r.label for r in M.merge_sessions(sessions(spark, rows), none).collect()}
        assert got == {"s": "new", "only": "x"}


def test_incoming_wins_ties_and_touch_falls_back(spark):
    rows = [("s", "local", 1, None, 1000, 0), ("s", "incoming", 1, None, 1000, 1),
            ("t", "done", 1, 4000, None, 0), ("t", "open", 3000, None, None, 1)]
    got = {r.session_id: r.label for r in M.merge_sessions(sessions(spark, rows), tombs(spark)).collect()}
    assert got == {"s": "incoming", "t": "done"}


def test_tombstone_beats_any_session_and_keeps_latest_time(spark):
    t = M.merge_tombstones(tombs(spark, [("a", 5000), ("a", 7000)]))
    assert t.first().deleted_at == 7000
    rows = [("a", "later edit", 1, None, 99_000, 1), ("b", "kept", 1, None, 1, 0)]
    assert [r.session_id for r in M.merge_sessions(sessions(spark, rows), t).collect()] == ["b"]


def test_attempts_collapse_by_session_item_time(spark):
    s = "user_id BIGINT, session_id STRING, question_id STRING, timestamp BIGINT, correct BOOLEAN, device_rank INT"
    same = spark.createDataFrame([(1, "s", "q", 5, True, 0), (1, "s", "q", 5, False, 1)], s)
    assert [r.correct for r in M.merge_attempts(same).collect()] == [False]
    other = spark.createDataFrame([(1, "s", "q", 5, True, 0), (1, "t", "q", 5, True, 1)], s)
    assert M.merge_attempts(other).count() == 2


def test_schedule_and_marks_last_write_wins(spark):
    s = "user_id BIGINT, question_id STRING, last_reviewed_at BIGINT, device_rank INT"
    df = spark.createDataFrame([(1, "q1", 9000, 0), (1, "q1", 2000, 1), (1, "q2", 1000, 0), (1, "q3", 3000, 1)], s)
    assert {r.question_id: r.last_reviewed_at for r in M.merge_srs(df).collect()} == {"q1": 9000, "q2": 1000, "q3": 3000}
    m = "user_id BIGINT, question_id STRING, updated_at BIGINT, resolved_at BIGINT, device_rank INT"
    for a, b in ((0, 1), (1, 0)):
        df = spark.createDataFrame([(1, "q", 2000, None, a), (1, "q", 8000, 8000, b)], m)
        assert M.merge_marks(df).first().resolved_at == 8000


def test_merge_is_idempotent(spark, rows):
    df = sessions(spark, [("s", "a", 1, None, 1000, 0), ("s", "b", 1, None, 1000, 1), ("t", "c", 1, 2, 3, 0)])
    once = M.merge_sessions(df, tombs(spark))
    both = once.withColumn("device_rank", F.lit(0)).unionByName(once.withColumn("device_rank", F.lit(1)))
    assert rows(M.merge_sessions(both, tombs(spark)), "session_id") == rows(once, "session_id")


def test_old_snapshot_migrates(spark):
    doc = {"version": 3, "sessions": [{"id": "s1", "createdAt": 1000, "finishedAt": 4000, "questionIds": ["q1"]}],
           "attempts": [{"questionId": "q1", "sessionId": "s1", "timestamp": 5, "correct": True}], "srs": {}}
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, "{broken"), (3, '{"sessions": []}'), (4, None)], "user_id BIGINT, data STRING")
    p = snapshots.parse(df)
    assert {r.user_id: r.valid for r in p.collect()} == {1: True, 2: False, 3: False, 4: False}
    s = snapshots.sessions(p).collect()
    assert len(s) == 1 and s[0].updated_at == 4000 and s[0].absences == [] and s[0].time_per_question == {}
    assert snapshots.attempts(p).first().seconds_spent == 0.0
    again = snapshots.parse(snapshots.export(p).withColumn("user_id", F.col("user_id")))
    assert again.filter("valid").count() == 4  # an empty snapshot is a valid document
    assert p.select("doc.version").distinct().first().version == 5


def test_snapshot_tables_round_trip(spark, tmp_path):
    doc = {"sessions": [], "attempts": [], "marks": {"q1": {"questionId": "q1", "reason": "erro", "timesMarked": 2, "createdAt": 1, "updatedAt": 2}},
           "srs": {"q1": {"questionId": "q1", "repetitions": 1, "intervalDays": 6, "easeFactor": 2.5, "dueAt": 9, "lastReviewedAt": 3}},
           "topicSrs": {"g": {"topicSlug": "g", "lastAccuracy": 0.5, "lastReviewedAt": 3}}, "deletedSessions": {"x": 7}}
    p = snapshots.parse(spark.createDataFrame([(1, json.dumps(doc))], "user_id BIGINT, data STRING"))
    snapshots.write_tables(p, str(tmp_path))
    t = snapshots.read_tables(spark, str(tmp_path))
    assert t["marks"].first().times_marked == 2 and t["srs"].first().interval_days == 6.0
    assert t["topic_srs"].first().last_accuracy == 0.5 and t["tombstones"].first().deleted_at == 7


def test_scratch_files(spark, tmp_path):
    (tmp_path / "u1").mkdir()
    (tmp_path / "u1" / "s1.json").write_text(json.dumps({"q1": {"text": "  ", "drawing": ""}, "q2": {"text": "x", "drawing": ""}}))
    (tmp_path / "u1" / "s2.json").write_text("{broken")
    got = sidefiles.read_scratch(spark, str(tmp_path)).collect()
    assert [(r.user_id, r.session_id, r.question_id, r.text) for r in got] == [("u1", "s1", "q2", "x")]
    sc = "user_id STRING, session_id STRING, question_id STRING, text STRING, drawing STRING"
    local = spark.createDataFrame([("u", "a", "q1", "mine", ""), ("u", "b", "q1", " ", "")], sc)
    remote = spark.createDataFrame([("u", "a", "q2", "theirs", ""), ("u", "b", "q2", "theirs", "")], sc)
    f = {(r.session_id, r.question_id): r.origin for r in sidefiles.fetch(local, remote).collect()}
    assert f == {("a", "q1"): "local", ("b", "q2"): "remote"}


def test_bank_documents(spark, tmp_path):
    q = {"id": "2019-01", "year": 2019, "number": 1, "area": "matematica", "image": "i", "answer": None, "annulled": True, "topics": ["g"]}
    (tmp_path / "bank.json").write_text(json.dumps({"generated_at": "x", "years": [2019, 2020], "questions": [q, {**q, "id": "2019-02", "number": 2}]}, indent=2))
    bank = B.read_bank(spark, str(tmp_path / "bank.json"))
    assert [(r.id, r.bank_pos) for r in bank.orderBy("bank_pos").collect()] == [("2019-01", 0), ("2019-02", 1)]
    assert B.read_exam_years(spark, str(tmp_path / "bank.json")).count() == 2
    B.write_bank(bank, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    kept = B.carry_over(bank.withColumn("topics", F.array()), bank.filter("number = 1"))
    assert {r.id: r.topics for r in kept.collect()} == {"2019-01": ["g"], "2019-02": []}


def test_delete_and_upsert_sessions(spark):
    base = sessions(spark, [("a", "x", 1, None, 5, 0), ("b", "y", 1, None, 5, 0)]).drop("device_rank")
    left, graves = M.delete_sessions(base, tombs(spark, [("z", 1)]), base.filter("session_id = 'a'"), 77)
    assert [r.session_id for r in left.collect()] == ["b"]
    assert {r.session_id: r.deleted_at for r in graves.collect()} == {"a": 77, "z": 1}
    up = M.upsert_sessions(base, base.filter("session_id = 'b'").withColumn("label", F.lit("new")), 88)
    assert {r.session_id: (r.label, r.updated_at) for r in up.collect()} == {"a": ("x", 5), "b": ("new", 88)}
