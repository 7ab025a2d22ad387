"""Session scoring, roll-ups, pacing, absences and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import core as fx
from ..session import sized


def session_items(sessions: DataFrame) -> DataFrame:
    """Explode session documents (ordered ids + per-item maps) into the item fact table."""
    qid = F.col("question_id")
    return sessions.select("*", F.posexplode("question_ids").alias("pos", "question_id")).select(
        "user_id",
        "session_id",
        "pos",
        "question_id",
        F.try_element_at("responses", qid).alias("response"),
        F.coalesce(F.try_element_at("flagged", qid), F.lit(False)).alias("flagged"),
        F.coalesce(F.try_element_at("time_per_question", qid), F.lit(0.0)).alias("seconds"),
        "created_at",
        "finished_at",
        "time_limit_seconds",
    )


def grade(items: DataFrame, questions: DataFrame, how: str = "inner") -> DataFrame:
    """Items joined with the bank plus `correct`; `how="left"` keeps ids missing from the bank."""
    bank = questions.select(
        "question_id", "year", "number", "area", "answer", "annulled", "topics", "bank_pos", F.lit(True).alias("known")
    )
    return sized(items, "question_id").join(bank, "question_id", how).withColumn(
        "correct", F.coalesce(fx.is_correct("annulled", "response", "answer"), F.lit(False))
    )


def score_sessions(graded: DataFrame, by=("user_id", "session_id"), sessions: DataFrame | None = None) -> DataFrame:
    """Totals per session; with `sessions`, those without any item have zeros.

    `incorrect = answered - correct` and `blank = total - answered` are kept as defined even
    where annulled blanks make `incorrect` negative; `total` counts ids missing from the bank.
    """
    known = F.coalesce(F.col("known"), F.lit(False))
    if sessions is not None:
        graded = sessions.select(*by).join(graded, list(by), "left")
    return (
        graded.groupBy(*by)
        .agg(
            F.count("question_id").alias("total"),
            F.count_if(known & F.col("response").isNotNull()).alias("answered"),
            F.count_if(known & F.col("correct")).alias("correct"),
        )
        .withColumn("incorrect", F.col("answered") - F.col("correct"))
        .withColumn("blank", F.col("total") - F.col("answered"))
    )


def score_by_area(graded: DataFrame) -> DataFrame:
    return graded.groupBy("user_id", "session_id", "area").agg(
        F.count("*").alias("total"), F.count_if("correct").alias("correct")
    )


def primary(topics="topics"):
    return F.try_element_at(fx.col(topics), F.lit(1))


def score_by_topic(graded: DataFrame, only_weak: bool = True) -> DataFrame:
    """Correct/total/rate per primary topic; worst first is (rate, -total)."""
    by = ["user_id", "session_id", "slug"]
    tagged = graded.withColumn("slug", primary()).filter("slug is not null").select(*by, "correct")
    out = (
        sized(tagged, *by)
        .groupBy(*by)
        .agg(F.count("*").alias("total"), F.count_if("correct").alias("correct"))
        .withColumn("rate", fx.ratio("correct", "total"))
    )
    return out.filter("rate < 1") if only_weak else out


def pacing(graded: DataFrame) -> DataFrame:
    """Time use per session over items that recorded time; sessions without any have no row."""
    right = F.when(F.col("correct"), F.col("seconds"))
    wrong = F.when(~F.col("correct"), F.col("seconds"))
    return (
        graded.filter("seconds > 0")
        .groupBy("user_id", "session_id")
        .agg(
            F.count("*").alias("measured"),
            F.sum("seconds").alias("total_seconds"),
            F.avg("seconds").alias("avg_seconds"),
            F.avg(right).alias("avg_correct"),
            F.avg(wrong).alias("avg_incorrect"),
        )
    )


def pacing_alert(pace: DataFrame) -> DataFrame:
    """Sessions whose wrong answers took much longer than the right ones."""
    wrong, right = F.col("avg_incorrect"), F.col("avg_correct")
    return pace.filter((wrong > right * 1.2) & (wrong - right >= 60)).select(
        "user_id", "session_id", fx.half_up((wrong / right - 1) * 100).alias("pct_more")
    )


def slowest_items(graded: DataFrame, k: int = 5) -> DataFrame:
    w = W.partitionBy("session_id").orderBy(F.desc("seconds"), "pos")
    return (
        graded.filter("seconds > 0")
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
        .select("user_id", "session_id", "rank", "question_id", "seconds", "correct")
    )


def absence_summary(sessions: DataFrame) -> DataFrame:
    """Summary of the `absences` array (seconds away, one entry per absence)."""
    a = F.col("absences")
    over = F.size(F.filter(a, lambda s: s > fx.MAX_AWAY_SECONDS))
    return sessions.select(
        "user_id",
        "session_id",
        F.size(a).alias("count"),
        F.coalesce(F.array_max(a), F.lit(0)).alias("longest_seconds"),
        over.alias("over_limit"),
        ((over > 0) | (F.size(a) >= fx.MAX_TAB_EXITS)).alias("would_be_flagged"),
    )


def session_counters(sessions: DataFrame, items: DataFrame) -> DataFrame:
    counts = items.groupBy("session_id").agg(
        F.count("*").alias("total"),
        F.count("response").alias("answered"),
        F.count_if("flagged").alias("flagged"),
    )
    all_sessions = sessions.select("user_id", "session_id", "time_limit_seconds", "elapsed_seconds")
    return all_sessions.join(counts, "session_id", "left").na.fill(0, ["total", "answered", "flagged"]).select(
        "user_id",
        "session_id",
        "answered",
        (F.col("total") - F.col("answered")).alias("blank"),
        "flagged",
        (F.col("time_limit_seconds") - F.col("elapsed_seconds")).alias("remaining"),
    )


def pace_deltas(sessions: DataFrame, items: DataFrame) -> DataFrame:
    counts = items.groupBy("session_id").agg(F.count("*").alias("total"), F.count("response").alias("answered"))
    # sessions without items have no pace: null target, delta and label
    j = sessions.join(counts, "session_id", "left").withColumn("target", fx.target_seconds("time_limit_seconds", "total"))
    j = j.withColumn("delta", fx.pace_delta("elapsed_seconds", "answered", "target"))
    return j.select("user_id", "session_id", "target", "delta", fx.pace_label("delta").alias("label"))


def attempt_rows(graded: DataFrame) -> DataFrame:
    """Attempt records of finished sessions, one per item found in the bank."""
    return graded.filter("finished_at is not null").select(
        "user_id",
        "session_id",
        "pos",
        "question_id",
        F.col("finished_at").alias("timestamp"),
        F.col("response").alias("answer"),
        "correct",
        F.coalesce("seconds", F.lit(0.0)).alias("seconds_spent"),
    )


def item_status(items: DataFrame, scratch: DataFrame) -> DataFrame:
    """Answered / flagged / scratched flags per item of a session."""
    s = scratch.filter(fx.has_content("text", "drawing")).select("session_id", "question_id").distinct()
    s = s.withColumn("_s", F.lit(True))
    return items.join(s, ["session_id", "question_id"], "left").select(
        "user_id",
        "session_id",
        "pos",
        "question_id",
        F.col("response").isNotNull().alias("answered"),
        "flagged",
        F.coalesce("_s", F.lit(False)).alias("scratched"),
    )


def triage(items: DataFrame, questions: DataFrame, marks: DataFrame) -> DataFrame:
    """Known items of a session that are marked and either flagged there or still open."""
    m = marks.select("user_id", "question_id", "reason", "resolved_at")
    return (
        items.join(questions.select("question_id"), "question_id", "left_semi")
        .join(m, ["user_id", "question_id"])
        .filter("flagged or resolved_at is null")
        .select(
            "user_id", "session_id", "pos", "question_id", "reason", F.col("resolved_at").isNull().alias("still_open")
        )
    )
