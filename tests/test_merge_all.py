"""One pass over all tables against the merges of single tables; scratch folders."""

import os
import random

from examloom.operators import merge as M
from examloom.session import materialize, scratch, shared_dir

SCHEMAS = {
    "sessions": "user_id BIGINT, session_id BIGINT, label STRING, created_at BIGINT, finished_at BIGINT, updated_at BIGINT, notes MAP<STRING,STRING>, device_rank INT",
    "attempts": "user_id BIGINT, session_id BIGINT, question_id BIGINT, timestamp BIGINT, answer STRING, correct BOOLEAN, seconds_spent DOUBLE, device_rank INT",
    "srs": "user_id BIGINT, question_id BIGINT, interval_days DOUBLE, last_reviewed_at BIGINT, device_rank INT",
    "topic_srs": "user_id BIGINT, slug STRING, last_reviewed_at BIGINT, last_accuracy DOUBLE, device_rank INT",
    "marks": "user_id BIGINT, question_id BIGINT, note STRING, updated_at BIGINT, device_rank INT",
    "tombstones": "user_id BIGINT, session_id BIGINT, deleted_at BIGINT",
}


def test_one_pass_equals_the_single_merges(spark):
    rng = random.Random(5)
    n = lambda k: rng.randrange(k)
    rows = {
        "sessions": [(n(3), n(9), f"s{k}", n(50), rng.choice([None, n(90)]), rng.choice([None, 1000 + k]), {"a": "b"}, n(3)) for k in range(60)],
        "attempts": [(n(3), n(9), n(3), n(4), rng.choice(["A", None]), True, float(k), k % 2) for k in range(80)],
        "srs": [(n(3), n(5), float(k), k, n(2)) for k in range(40)],
        "topic_srs": [(n(3), f"t{n(4)}", k, 0.5, n(2)) for k in range(40)],
        "marks": [(n(3), n(5), f"n{k}", k, n(2)) for k in range(40)],
        "tombstones": [(n(3), n(9), n(100)) for k in range(6)],
    }
    t = {k: spark.createDataFrame(v, SCHEMAS[k]) for k, v in rows.items()}
    got = M.merge_all(**t)
    graves = M.merge_tombstones(t["tombstones"])
    want = {
        "sessions": M.merge_sessions(t["sessions"], graves), "srs": M.merge_srs(t["srs"]), "topic_srs": M.merge_topic_srs(t["topic_srs"]),
        "marks": M.merge_marks(t["marks"]), "tombstones": graves,
    }
    plain = lambda df, cols: sorted(map(repr, df.select(*cols).collect()))
    for kind, df in want.items():
        assert plain(got[kind], df.columns) == plain(df, df.columns), kind
    keys = M.ATTEMPT_KEYS
    assert plain(got["attempts"], keys) == plain(M.merge_attempts(t["attempts"]), keys)
    again = M.merge_all(**{k: v.orderBy("user_id") for k, v in t.items()})
    assert plain(again["attempts"], got["attempts"].columns) == plain(got["attempts"], got["attempts"].columns)
    empty = M.merge_all(**{k: v.limit(0) for k, v in t.items()})
    assert all(df.count() == 0 for df in empty.values())


def test_scratch_keeps_results_and_removes_the_rest(spark):
    def place(df):
        return os.path.dirname(df.inputFiles()[0].removeprefix("file://"))

    with scratch(spark) as keep:
        with scratch(spark) as inner:
            lost = place(materialize(spark.range(3), "lost"))
            handed = inner(spark.range(4), "handed")  # an inner result lives as long as the outer scope
        assert handed.count() == 4 and not os.path.exists(lost)
        kept = keep(spark.range(5), "kept")
    assert kept.count() == 5 and not os.path.exists(place(handed))
    assert shared_dir(spark, "x") != shared_dir(spark, "x")
