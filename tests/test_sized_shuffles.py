"""Shuffles grow in parts with the input; the merge of all tables carries no more than each table's own rows."""

from examloom import session
from examloom.operators import merge as M
from examloom.operators import scoring as S

SRS = "user_id BIGINT, slug STRING, last_reviewed_at BIGINT, last_accuracy DOUBLE, device_rank INT"


def stored(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).write.parquet(str(path))
    return spark.read.parquet(str(path))



def test_parts_grow_with_the_input(spark, tmp_path, monkeypatch):
    df = stored(spark, [(k, f"t{k}", k, 0.5, 0) for k in range(2000)], SRS, tmp_path / "srs")
    assert session.sized(df, "user_id") is df  # small: as it is
    monkeypatch.setattr(session, "TASK_BYTES", 100)
    assert session.sized(df, "user_id").rdd.getNumPartitions() > 4
    made = spark.createDataFrame([(1, "a", 1, 0.5, 0)], SRS)
    assert session.sized(made, "user_id") is made  # its size is not known


def test_merges_and_scores_of_large_tables(spark, tmp_path, monkeypatch):
    copies = [(k % 50, f"t{k % 7}", k // 2, k / 8, k % 2) for k in range(3000)]
    df = stored(spark, copies, SRS, tmp_path / "srs")
    graded = stored(spark, [(k % 50, k % 200, k, ["a", "b"] if k % 3 else None, k % 4 == 0) for k in range(3000)],
                    "user_id BIGINT, session_id BIGINT, question_id BIGINT, topics ARRAY<STRING>, correct BOOLEAN", tmp_path / "graded")
    steps = (lambda: M.merge_topic_srs(df), lambda: S.score_by_topic(graded))
    small = [sorted(map(repr, step().collect())) for step in steps]
    monkeypatch.setattr(session, "TASK_BYTES", 100)
    large = [step() for step in steps]
    assert all(x.rdd.getNumPartitions() > 4 for x in large)
    assert [sorted(map(repr, x.collect())) for x in large] == small and all(small)


def test_merge_all_shuffles_own_rows(spark):
    t = {
        "sessions": spark.createDataFrame([(1, 1, "s", 1, 2, 3, {"a": "b"}, 0), (1, 2, "s", 1, 2, 3, None, 0)],
                                          "user_id BIGINT, session_id BIGINT, label STRING, created_at BIGINT, finished_at BIGINT, updated_at BIGINT, notes MAP<STRING,STRING>, device_rank INT"),
        "attempts": spark.createDataFrame([(1, 1, 1, 1, "A", None, 2.0, 0), (1, 1, 1, 1, None, True, 2.0, 0)],
                                          "user_id BIGINT, session_id BIGINT, question_id BIGINT, timestamp BIGINT, answer STRING, correct BOOLEAN, seconds_spent DOUBLE, device_rank INT"),
        "srs": spark.createDataFrame([(1, 1, 2.0, 5, 0)], "user_id BIGINT, question_id BIGINT, interval_days DOUBLE, last_reviewed_at BIGINT, device_rank INT"),
        "topic_srs": spark.createDataFrame([(1, "a", 5, 0.5, 0)], SRS),
        "marks": spark.createDataFrame([(1, 1, "n", 5, 0)], "user_id BIGINT, question_id BIGINT, note STRING, updated_at BIGINT, device_rank INT"),
        "tombstones": spark.createDataFrame([(1, 2, 5)], "user_id BIGINT, session_id BIGINT, deleted_at BIGINT"),
    }
    out = M.merge_all(**t)
    assert {k: df.count() for k, df in out.items()} == {k: 1 for k in t}
    for kind in ("attempts", "srs", "topic_srs", "marks"):
        plan = out[kind]._jdf.queryExecution().optimizedPlan().toString()
        assert "to_json" not in plan and "label" not in plan and "deleted_at" not in plan, kind
