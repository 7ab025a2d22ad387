"""Last-write-wins merge of any number of device copies, table by table.

Every input row carries `device_rank`; the higher rank is the "incoming" side and wins ties. Each
merge is one aggregate (`max_by` over the stamp; Spark sorts for it), so a key with very many copies
is reduced on the map side (of large tables in one task, which spills), and merging a result with itself changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import core as fx
from ..session import sized

SNAPSHOT_VERSION = 5
ATTEMPT_KEYS = ["user_id", "session_id", "question_id", "timestamp"]


def lww(rows: DataFrame, keys: list[str], stamp: Column | None = None, tie: tuple[str | Column, ...] = ()) -> DataFrame:
    """Latest row per key; without a stamp the highest device rank wins. Columns `tie` settle what is still equal."""
    rest = [c for c in rows.columns if c not in keys and c != "device_rank"]
    order = F.struct(*([] if stamp is None else [stamp]), "device_rank", *tie)
    best = sized(rows, *keys).groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_v"))
    return best.select(*keys, "_v.*")


def merge_tombstones(rows: DataFrame) -> DataFrame:
    return rows.groupBy("user_id", "session_id").agg(F.max("deleted_at").alias("deleted_at"))


def merge_sessions(rows: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Sessions by last touch, minus every session any device deleted (whatever the times)."""
    alive = rows.join(tombstones.select("user_id", "session_id").distinct(), ["user_id", "session_id"], "left_anti")
    return lww(alive, ["user_id", "session_id"], fx.touched_at("updated_at", "finished_at", "created_at"))


def merge_attempts(rows: DataFrame) -> DataFrame:
    """Attempts are facts: same session, item and time collapse; deletion does not touch them.

    Copies of one device that differ are settled by their content.
    """
    tie = tuple(c for c in ("answer", "correct", "seconds_spent") if c in rows.columns)
    return lww(rows, ATTEMPT_KEYS, tie=tie)


def merge_srs(rows: DataFrame) -> DataFrame:
    return lww(rows, ["user_id", "question_id"], F.col("last_reviewed_at"))


def merge_topic_srs(rows: DataFrame) -> DataFrame:
    return lww(rows, ["user_id", "slug"], F.col("last_reviewed_at"))


def merge_marks(rows: DataFrame) -> DataFrame:
    return lww(rows, ["user_id", "question_id"], F.col("updated_at"))


def merge_all(sessions: DataFrame, attempts: DataFrame, srs: DataFrame, topic_srs: DataFrame, marks: DataFrame,
              tombstones: DataFrame) -> dict[str, DataFrame]:
    """The six merged tables from all device copies (each with `device_rank`, tombstones without).

    Every table is one aggregate over its own keys and columns, so no row carries more through the shuffle than it has.
    Tombstones take their sessions out. Equal stamps of one device are settled by the rows' content.
    """
    stamps = {
        "sessions": (sessions, ["user_id", "session_id"], fx.touched_at("updated_at", "finished_at", "created_at")),
        "attempts": (attempts, ATTEMPT_KEYS, None),
        "srs": (srs, ["user_id", "question_id"], F.col("last_reviewed_at")),
        "topic_srs": (topic_srs, ["user_id", "slug"], F.col("last_reviewed_at")),
        "marks": (marks, ["user_id", "question_id"], F.col("updated_at")),
    }
    out = {kind: lww(rows, keys, stamp, tie=(content(rows, keys),)) for kind, (rows, keys, stamp) in stamps.items()}
    graves = merge_tombstones(tombstones)
    alive = out["sessions"].join(graves.select("user_id", "session_id"), ["user_id", "session_id"], "left_anti")
    return out | {"sessions": alive, "tombstones": graves}


def content(rows: DataFrame, keys: list[str]) -> Column:
    """A hash of a row's content beside its keys, nulls told apart from values; columns of maps and the like as JSON."""
    plain = {f.name: F.to_json(F.struct(f.name)) if "<" in f.dataType.simpleString() else F.col(f.name)
             for f in rows.schema if f.name not in (*keys, "device_rank")}
    return F.xxhash64(*[x for c in plain.values() for x in (c.isNull(), c)])


def migrate_sessions(sessions: DataFrame) -> DataFrame:
    """Fill what older versions did not record."""
    out = sessions.withColumn("updated_at", fx.touched_at("updated_at", "finished_at", "created_at"))
    if "time_per_question" in sessions.columns:
        empty = F.create_map().cast("map<string,double>")
        out = out.withColumn("time_per_question", F.coalesce("time_per_question", empty))
    if "absences" in sessions.columns:
        out = out.withColumn("absences", F.coalesce("absences", F.array().cast("array<int>")))
    return out


def migrate_attempts(attempts: DataFrame) -> DataFrame:
    return attempts.withColumn("seconds_spent", F.coalesce("seconds_spent", F.lit(0.0)))


def upsert_sessions(sessions: DataFrame, changed: DataFrame, now: int) -> DataFrame:
    """Store changed sessions, stamped with the time of writing."""
    stamped = changed.withColumn("updated_at", F.lit(now).cast("bigint")).withColumn("device_rank", F.lit(1))
    rows = sessions.withColumn("device_rank", F.lit(0)).unionByName(stamped)
    return lww(rows, ["user_id", "session_id"])


def delete_sessions(sessions: DataFrame, tombstones: DataFrame, doomed: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """Remaining sessions, and tombstones with one entry per deleted session."""
    keys = ["user_id", "session_id"]
    d = doomed.select(*keys).distinct()
    graves = tombstones.unionByName(d.withColumn("deleted_at", F.lit(now).cast("bigint")))
    return sessions.join(d, keys, "left_anti"), merge_tombstones(graves)


def append_attempts(attempts: DataFrame, new: DataFrame) -> DataFrame:
    """New attempts after the stored ones; `seq` keeps counting from what the caller assigned."""
    return attempts.unionByName(new)


def session(sessions: DataFrame, session_id) -> DataFrame:
    """One session by id."""
    return sessions.filter(F.col("session_id") == F.lit(session_id))
