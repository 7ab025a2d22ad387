"""Answer history: latest attempt, accuracy roll-ups, most-missed items, evolution.

Everything here is a hash aggregate (map-side combined), so one very active user or one very
popular item costs one partial row per map task, not one oversized reducer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import core as fx


def latest_attempt(attempts: DataFrame, keys=("user_id", "question_id"), tie: str = "last") -> DataFrame:
    """Latest attempt per key. On equal times the last (`tie="last"`) or first row in `seq` order wins.

    `max_by` over a struct instead of `row_number`: no sort, and partial aggregation before the shuffle.
    """
    rest = [c for c in attempts.columns if c not in keys]
    seq = F.col("seq") if tie == "last" else -F.col("seq")
    best = F.max_by(F.struct(*rest), F.struct("timestamp", seq))
    return attempts.groupBy(*keys).agg(best.alias("_a")).select(*keys, "_a.*")


def last_seen(attempts: DataFrame, keys=("user_id", "question_id")) -> DataFrame:
    return attempts.groupBy(*keys).agg(F.max("timestamp").alias("last_seen"))


def accuracy(latest: DataFrame, questions: DataFrame, by=("user_id",)) -> DataFrame:
    """Share of latest attempts that were correct; blanks count as wrong, unknown items are dropped."""
    bank = questions.select("question_id", *[c for c in by if c in questions.columns])
    return (
        latest.select("question_id", "correct", *[c for c in by if c in latest.columns])
        .join(bank, "question_id")
        .groupBy(*by)
        .agg(F.count("*").alias("total"), F.count_if("correct").alias("correct"))
        .withColumn("pct", fx.percent("correct", "total"))
    )


def most_wrong(attempts: DataFrame, questions: DataFrame, k: int = 10) -> DataFrame:
    """Per user, the k known items missed most often; earlier first miss first on ties."""
    counts = (
        attempts.filter(~F.col("correct"))
        .groupBy("user_id", "question_id")
        .agg(F.count("*").alias("wrong"), F.min(F.struct("timestamp", "seq")).alias("_first"))
        .join(questions.select("question_id"), "question_id", "left_semi")
    )
    w = W.partitionBy("user_id").orderBy(F.desc("wrong"), "_first", "question_id")
    return (
        counts.withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
        .select("user_id", "question_id", "wrong", "rank")
    )


def evolution(sessions: DataFrame, scores: DataFrame) -> DataFrame:
    """Percentage per finished session with its date, oldest first within each user."""
    s = sessions.filter("finished_at is not null").select("user_id", "session_id", "finished_at", "label")
    return s.join(scores.select("session_id", "total", "correct"), "session_id", "left").select(
        "user_id",
        "session_id",
        "finished_at",
        fx.local_date("finished_at").alias("date"),
        F.when(F.col("total") > 0, fx.percent("correct", "total")).otherwise(F.lit(0).cast("bigint")).alias("pct"),
        "label",
    )


def history_table(sessions: DataFrame, scores: DataFrame) -> DataFrame:
    elapsed = sessions.select("session_id", fx.hours_minutes("elapsed_seconds").alias("duration"))
    return evolution(sessions, scores).join(elapsed, "session_id")
