"""The split-by-size paths agree with the plain folds and with naive loops."""

import random

from pyspark.sql import functions as F

from examloom.operators import marks as R
from examloom.operators import schedule as N
from examloom.operators import slices


def outcomes(spark, n=3000, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        user = 1 if rnd.random() < 0.34 else rnd.randint(2, 200)
        rows.append((user, rnd.randint(0, 40) * 43_200_000, i, rnd.choice([0, 1, 2, 3, 4, 4, 5, 5])))
    return spark.createDataFrame(rows, "user_id BIGINT, t BIGINT, seq BIGINT, q INT")


def test_long_rebuild_equals_fold(spark):
    df = outcomes(spark)
    short = {r.user_id: r for r in N.rebuild_short(df, ["user_id"]).collect()}
    long = {r.user_id: r for r in N.rebuild_long(df, ["user_id"]).collect()}
    mixed = {r.user_id: r for r in N.rebuild(df, ["user_id"], max_group=20).collect()}
    assert short.keys() == long.keys() == mixed.keys()
    for k, s in short.items():
        for other in (long[k], mixed[k]):
            assert (s.repetitions, s.interval_days, s.due_at, s.last_reviewed_at, s.reviews) == (
                other.repetitions, other.interval_days, other.due_at, other.last_reviewed_at, other.reviews)
            assert abs(s.ease_factor - other.ease_factor) < 1e-9


def test_endless_run_has_an_infinite_interval_in_both_paths(spark):
    df = spark.range(3500).select(
        F.lit(1).cast("bigint").alias("user_id"), (F.col("id") * 3_600_000).alias("t"), F.col("id").alias("seq"), F.lit(3).alias("q"))
    a = N.rebuild_short(df, ["user_id"]).first()
    b = N.rebuild_long(df, ["user_id"]).first()
    assert a.interval_days == b.interval_days == float("inf")
    assert a.repetitions == b.repetitions == 3500 and a.due_at == b.due_at


def test_long_mark_replay_equals_fold(spark, rows):
    rnd = random.Random(5)
    data = []
    for i in range(2500):
        q = 1 if rnd.random() < 0.34 else rnd.randint(2, 150)
        data.append((7, q, rnd.randint(0, 30) * 50_000_000, i, rnd.choice(R.ACTIONS), rnd.choice(["erro", "chute"]), i))
    log = spark.createDataFrame(
        data, "user_id BIGINT, question_id BIGINT, at BIGINT, seq BIGINT, action STRING, reason STRING, session_id BIGINT")
    short = rows(R.replay_short(log), "question_id")
    assert short == rows(R.replay_long(log), "question_id")
    assert short == rows(R.replay(log, max_group=15), "question_id")


def test_slices_match_plain_windows(spark, rows):
    from pyspark.sql import Window as W

    rnd = random.Random(1)
    data = [(rnd.choice([1, 1, 1, 2, 3]), rnd.randint(0, 99), i, rnd.randint(-5, 5)) for i in range(600)]
    df = spark.createDataFrame(data, "k INT, t INT, seq INT, v INT").withColumn("s", F.floor(F.col("t") / 10))
    w = W.partitionBy("k").orderBy("t", "seq")
    cum = w.rowsBetween(W.unboundedPreceding, 0)
    plain = df.select(
        "seq", F.row_number().over(w).cast("bigint").alias("r"), F.lag("v").over(w).alias("p"), F.lead("v").over(w).alias("n"),
        F.sum("v").over(cum).alias("c"), F.min("v").over(cum).alias("m"),
        F.last(F.when(F.col("v") > 3, F.col("t")), True).over(cum).alias("st"))
    order = ["t", "seq"]
    x = slices.rank(df, ["k"], "s", order, out="r")
    x = slices.neighbours(x, ["k"], "s", order, lag={"p": "v"}, lead={"n": "v"})
    x = slices.running_sum(x, ["k"], "s", order, {"c": F.col("v")})
    x = slices.running_min(x, ["k"], "s", order, {"m": F.col("v")})
    x = slices.carry_start(x, ["k"], "s", order, F.col("v") > 3, "t", "st")
    assert rows(plain, "seq") == rows(x.select("seq", "r", "p", "n", "c", "m", "st"), "seq")
