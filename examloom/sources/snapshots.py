"""Snapshot documents: tolerant parsing, validation, explosion into tables, export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import core as fx
from . import schemas

VERSION = 5


def parse(docs: DataFrame, column: str = "data") -> DataFrame:
    """Parsed snapshot in `doc` and whether it was usable.

    Corrupt JSON, or a document without `sessions` or `attempts`, becomes the empty snapshot.
    """
    raw = F.from_json(column, schemas.SNAPSHOT, {"mode": "PERMISSIVE"})
    d = docs.withColumn("_d", raw)
    ok = F.col("_d.sessions").isNotNull() & F.col("_d.attempts").isNotNull()
    fields = [F.lit(VERSION).alias("version")]
    for name, ddl in schemas.SNAPSHOT_FIELDS.items():
        empty = (F.array() if ddl.startswith("ARRAY") else F.create_map()).cast(ddl)
        fields.append(F.coalesce(F.when(ok, F.col(f"_d.{name}")), empty).alias(name))
    return d.withColumn("valid", F.coalesce(ok, F.lit(False))).withColumn("doc", F.struct(*fields)).drop("_d")


def sessions(parsed: DataFrame, keys=("user_id",)) -> DataFrame:
    s = parsed.select(*keys, F.explode("doc.sessions").alias("s"))
    return s.select(
        *keys,
        F.col("s.id").alias("session_id"),
        F.col("s.mode").alias("mode"),
        F.col("s.label").alias("label"),
        F.col("s.createdAt").alias("created_at"),
        F.col("s.finishedAt").alias("finished_at"),
        F.col("s.correctionMode").alias("correction_mode"),
        F.col("s.timeLimitSeconds").alias("time_limit_seconds"),
        F.col("s.questionIds").alias("question_ids"),
        F.col("s.responses").alias("responses"),
        F.col("s.flagged").alias("flagged"),
        F.col("s.elapsedSeconds").alias("elapsed_seconds"),
        F.coalesce("s.timePerQuestion", F.create_map().cast("map<string,double>")).alias("time_per_question"),
        F.coalesce("s.absences", F.array().cast("array<int>")).alias("absences"),
        fx.touched_at("s.updatedAt", "s.finishedAt", "s.createdAt").alias("updated_at"),
    )


def attempts(parsed: DataFrame, keys=("user_id",)) -> DataFrame:
    a = parsed.select(*keys, F.posexplode("doc.attempts").alias("seq", "a"))
    return a.select(
        *keys,
        F.col("a.questionId").alias("question_id"),
        F.col("a.sessionId").alias("session_id"),
        F.col("a.timestamp").alias("timestamp"),
        F.col("a.answer").alias("answer"),
        F.col("a.correct").alias("correct"),
        F.coalesce("a.secondsSpent", F.lit(0.0)).alias("seconds_spent"),
        F.col("seq").cast("bigint").alias("seq"),
    )


def _schedule(v: str) -> list:
    return [
        F.col(f"{v}.repetitions").alias("repetitions"),
        F.col(f"{v}.intervalDays").alias("interval_days"),
        F.col(f"{v}.easeFactor").alias("ease_factor"),
        F.col(f"{v}.dueAt").alias("due_at"),
        F.col(f"{v}.lastReviewedAt").alias("last_reviewed_at"),
    ]


def srs(parsed: DataFrame, keys=("user_id",)) -> DataFrame:
    return parsed.select(*keys, F.explode("doc.srs").alias("question_id", "v")).select(*keys, "question_id", *_schedule("v"))


def topic_srs(parsed: DataFrame, keys=("user_id",)) -> DataFrame:
    return parsed.select(*keys, F.explode("doc.topicSrs").alias("slug", "v")).select(
        *keys, "slug", *_schedule("v"), F.col("v.lastAccuracy").alias("last_accuracy")
    )


def marks(parsed: DataFrame, keys=("user_id",)) -> DataFrame:
    return parsed.select(*keys, F.explode("doc.marks").alias("question_id", "v")).select(
        *keys,
        "question_id",
        F.col("v.reason").alias("reason"),
        F.col("v.note").alias("note"),
        F.col("v.sessionId").alias("session_id"),
        F.col("v.createdAt").alias("created_at"),
        F.col("v.updatedAt").alias("updated_at"),
        F.col("v.resolvedAt").alias("resolved_at"),
        F.col("v.timesMarked").alias("times_marked"),
    )


def tombstones(parsed: DataFrame, keys=("user_id",)) -> DataFrame:
    return parsed.select(*keys, F.explode("doc.deletedSessions").alias("session_id", "deleted_at"))


TABLES = {"sessions": sessions, "attempts": attempts, "srs": srs, "topic_srs": topic_srs, "marks": marks, "tombstones": tombstones}


def explode_all(parsed: DataFrame, keys=("user_id",)) -> dict[str, DataFrame]:
    return {name: fn(parsed, keys) for name, fn in TABLES.items()}


def write_tables(parsed: DataFrame, root: str, keys=("user_id",)) -> None:
    for name, df in explode_all(parsed, keys).items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")


def read_tables(spark, root: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{root}/{name}") for name in TABLES}


def export(parsed: DataFrame, keys=("user_id",)) -> DataFrame:
    """Snapshots back to JSON text, one document per input row."""
    return parsed.select(*keys, F.to_json("doc").alias("data"))


def upsert_user_data(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """One document row per user: the latest `updated_at`, incoming first on ties."""
    both = stored.withColumn("_r", F.lit(0)).unionByName(incoming.withColumn("_r", F.lit(1)))
    best = both.groupBy("user_id").agg(F.max_by(F.struct("data", "updated_at"), F.struct("updated_at", "_r")).alias("_v"))
    return best.select("user_id", "_v.*")


def reset_users(stored: DataFrame, users: DataFrame) -> DataFrame:
    return stored.join(users.select("user_id").distinct(), "user_id", "left_anti")


def owned_by(rows: DataFrame, user_id) -> DataFrame:
    """Rows of one owner."""
    return rows.filter(F.col("user_id") == F.lit(user_id))


def path_owner(path):
    """Owner of a side file: the first path segment."""
    return F.split(fx.col(path), "/")[0]
