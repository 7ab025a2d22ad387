"""Batches from stored states at any length, late reviews in a stream, marks seeded session by session."""

import random

import pytest
from pyspark.sql import functions as F

from examloom.operators import marks as R
from examloom.operators import schedule as N
from examloom.streaming import jobs

OUTCOME = "user_id BIGINT, item BIGINT, t BIGINT, seq BIGINT, q INT"


def histories(seed, n, users=6, items=5):
    rng = random.Random(seed)
    return [(rng.randrange(users), rng.randrange(items), rng.randrange(1_000_000), k, rng.choice([0, 2, 3, 4, 5, 5])) for k in range(n)]


def test_long_batches_go_on_from_the_stored_state(spark):
    first = spark.createDataFrame(histories(1, 400), OUTCOME)
    later = [(u, i, t + 2_000_000, s, q) for u, i, t, s, q in histories(2, 500, items=7)]
    # runs without a lapse, a lapse at the end, and a fresh key
    later += [(0, 0, 4_000_000 + k, 900 + k, 5) for k in range(4)] + [(1, 1, 4_000_000, 999, 0), (50, 1, 4_000_000, 1, 5), (50, 1, 4_000_001, 2, 4)]
    later = spark.createDataFrame(later, OUTCOME)
    keys = ["user_id", "item"]
    old = N.rebuild_short(first, keys).drop("reviews")
    rows = lambda df: sorted(map(tuple, df.select(*keys, *N.STATE).collect()))
    whole = rows(N.rebuild_short(first.unionByName(later), keys))
    assert rows(N.apply_outcomes(old, later, keys)) == whole
    assert rows(N.apply_outcomes(old, later, keys, max_group=2)) == whole
    assert rows(N.apply_outcomes(old, later.limit(0), keys)) == rows(old)
    assert rows(N.apply_outcomes(old.limit(0), first, keys, max_group=1)) == rows(old)


def test_late_reviews_repair_their_keys_only(spark, tmp_path):
    rows = histories(3, 300)
    for n in range(4):  # any order over four batches
        part = rows[n::4] if n else rows[::4] + [(None, 1, 5, 1000, 5)]
        spark.createDataFrame(part, OUTCOME).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(OUTCOME).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    keys = ["user_id", "item"]
    out = jobs.running_schedules(stream, keys)
    assert spark.read.parquet(out).select("batch").distinct().count() == 4
    last = jobs.latest_versions(spark, out, keys, "batch_no")
    cols = [*keys, *N.STATE, "reviews"]
    want = N.rebuild(spark.createDataFrame(rows, OUTCOME), keys)
    assert sorted(map(tuple, last.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


GRADED = ("user_id BIGINT, session_id BIGINT, pos INT, question_id BIGINT, correct BOOLEAN, flagged BOOLEAN, seconds DOUBLE, "
          "time_limit_seconds INT, finished_at BIGINT")
MARKS = "user_id BIGINT, question_id BIGINT, reason STRING, note STRING, session_id BIGINT, created_at BIGINT, updated_at BIGINT, resolved_at BIGINT, times_marked BIGINT"


@pytest.mark.parametrize("seed", [1, 2])
def test_marks_are_seeded_session_by_session(spark, seed):
    rng = random.Random(seed)
    graded = [(rng.randrange(3), s, p, rng.randrange(6), rng.random() < 0.5, rng.random() < 0.6, float(rng.randrange(40)), rng.choice([None, 100]),
               rng.choice([None, 100 * (s % 7 + 1)])) for s in range(25) for p in range(3)]
    owner = {}
    graded = [(owner.setdefault(s, u), s, p, q, c, f, sec, lim, at) for u, s, p, q, c, f, sec, lim, at in graded]
    ends, limits = {}, {}
    graded = [(*g[:7], limits.setdefault(g[1], g[7]), ends.setdefault(g[1], g[8])) for g in graded]
    marks = [(u, q, "duvida", "n", 77, 10, 300, rng.choice([None, 300]), 2) for u in range(3) for q in range(3)]
    sizes = [(s, 3) for s in range(25)]
    pace = [(s, 10.0) for s in range(25)]
    g = spark.createDataFrame(graded, GRADED)
    m = spark.createDataFrame(marks, MARKS)
    new = R.seed_marks(g, m, spark.createDataFrame(pace, "session_id BIGINT, avg_seconds DOUBLE"), spark.createDataFrame(sizes, "session_id BIGINT, items BIGINT"))
    stored = {(r[0], r[1]): list(r[2:]) for r in marks}
    touched = set()
    for row in sorted((r for r in graded if r[8] is not None), key=lambda r: (r[8], r[1], r[2])):
        u, s, _, q, correct, flagged, sec, limit, at = row
        prev = stored.get((u, q))
        if not flagged or prev and (prev[5] is None or prev[4] >= at):
            continue
        ref = limit / 3 if limit else 10.0
        reason = "erro" if not correct else "lento" if sec > 2 * ref else "chute"
        stored[u, q] = [reason, prev[1] if prev else "", s, prev[3] if prev else at, at, None, (prev[6] if prev else 0) + 1]
        touched.add((u, q))
    assert {(r.user_id, r.question_id) for r in new.collect()} == touched and new.count() == len(touched)
    got = {(r.user_id, r.question_id): list(r)[2:] for r in R.save_marks(m, new).collect()}
    assert got == stored
    assert new.filter(F.col("resolved_at").isNotNull()).count() == 0
