"""Review marks: applying, seeding, replaying and rolling up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import core as fx
from ..session import materialize
from . import slices
from .schedule import upsert
from .scoring import primary

MARK = ["reason", "note", "session_id", "created_at", "updated_at", "resolved_at", "times_marked"]


def mark(prev: Column, reason: Column, session_id: Column, now: Column, note: Column | None = None,
         count_again: Column | None = None) -> Column:
    """Create or re-mark: the first creation time and note stay; the counter grows only when the
    item was new or resolved (or as `count_again` says, for edits that never count)."""
    again = (prev.isNull() | prev["resolved_at"].isNotNull()) if count_again is None else count_again
    null = F.lit(None)
    return F.struct(
        reason.alias("reason"),
        F.coalesce(null.cast("string") if note is None else note, prev["note"], F.lit("")).alias("note"),
        session_id.alias("session_id"),
        F.coalesce(prev["created_at"], now).alias("created_at"),
        now.alias("updated_at"),
        null.cast("bigint").alias("resolved_at"),
        (F.coalesce(prev["times_marked"], F.lit(0).cast("bigint")) + again.cast("bigint")).alias("times_marked"),
    )


def with_resolved(prev: Column, resolved_at: Column, now: Column) -> Column:
    """Resolve or re-open without touching the counter."""
    return F.struct(
        *[prev[c].alias(c) for c in ("reason", "note", "session_id", "created_at")],
        now.alias("updated_at"),
        resolved_at.cast("bigint").alias("resolved_at"),
        prev["times_marked"].alias("times_marked"),
    )


def edit(prev: Column, reason: Column, note: Column, now: Column) -> Column:
    """Change reason or note: re-opens, never counts as a new mark."""
    return mark(
        prev, F.coalesce(reason, prev["reason"]), prev["session_id"], now, F.coalesce(note, prev["note"]), F.lit(False)
    )


def _stored(marks: DataFrame) -> DataFrame:
    return marks.select("user_id", "question_id", F.struct(*MARK).alias("_prev"))


def apply_marks(marks: DataFrame, inputs: DataFrame) -> DataFrame:
    """New state of every marked item; `inputs` has user_id, question_id, session_id, reason, at[, note]."""
    note = F.col("note") if "note" in inputs.columns else None
    j = inputs.join(_stored(marks), ["user_id", "question_id"], "left")
    new = mark(F.col("_prev"), F.col("reason"), F.col("session_id"), F.col("at"), note)
    return j.select("user_id", "question_id", new.alias("_m")).select("user_id", "question_id", "_m.*")


def seed_marks(graded: DataFrame, marks: DataFrame, pacing: DataFrame, sizes: DataFrame) -> DataFrame:
    """Marks raised by flagged items of finished sessions, as if each session were seeded when it ends: one row per item.

    Items whose mark is open, or was touched at or after the end of the session, are left alone. A seeded mark is open, so
    it keeps later sessions of the batch away, and the fold over a user's sessions is the first one that may mark.
    The reference time is the target pace, else the session's mean time per item.
    """
    flagged = graded.filter("finished_at is not null and flagged")
    ref = F.coalesce(fx.target_seconds("time_limit_seconds", "items"), F.col("avg_seconds"))
    stored = marks.select("user_id", "question_id", "resolved_at", "updated_at").withColumn("_known", F.lit(True))
    j = (
        flagged.join(sizes, "session_id")
        .join(pacing.select("session_id", "avg_seconds"), "session_id", "left")
        .join(stored.withColumnRenamed("updated_at", "_touched"), ["user_id", "question_id"], "left")
    )
    skip = F.col("_known").isNotNull() & (F.col("resolved_at").isNull() | (F.col("_touched") >= F.col("finished_at")))
    reason = fx.suggest_reason("correct", F.coalesce("seconds", F.lit(0.0)), ref)
    first = j.filter(~F.coalesce(skip, F.lit(False))).groupBy("user_id", "question_id").agg(
        F.min_by(F.struct("session_id", "pos", F.col("finished_at").alias("at"), reason.alias("reason")),
                 F.struct("finished_at", "session_id", "pos")).alias("_f")
    )
    new = first.select("user_id", "question_id", "_f.*").join(_stored(marks), ["user_id", "question_id"], "left")
    new = new.select("user_id", "question_id", "pos", mark(F.col("_prev"), F.col("reason"), F.col("session_id"), F.col("at")).alias("_m"))
    return new.select("user_id", "question_id", "pos", "_m.*")


def save_marks(marks: DataFrame, new: DataFrame) -> DataFrame:
    """The marks table after an upsert of new or changed marks; the latest change of a key wins."""
    cols = ["user_id", "question_id", *MARK]
    return upsert(marks.select(*cols), new.select(*cols), ["user_id", "question_id"], ["updated_at"])


def suggestions(graded: DataFrame, sizes: DataFrame, pacing: DataFrame) -> DataFrame:
    ref = F.coalesce(fx.target_seconds("time_limit_seconds", "items"), F.col("avg_seconds"))
    j = graded.join(sizes, "session_id").join(pacing.select("session_id", "avg_seconds"), "session_id", "left")
    return j.select("user_id", "session_id", "pos", "question_id", fx.suggest_reason("correct", "seconds", ref).alias("reason"))


ACTIONS = ["mark", "resolve", "unresolve", "edit", "toggle"]


def replay(log: DataFrame, max_group: int = 100_000) -> DataFrame:
    """Final mark per (user, item) after an action log (`action`, `reason`, `session_id`, `at`, `seq`).

    `toggle` is the notebook's switch: it resolves an open mark and re-marks a resolved one.
    Actions other than `mark` on an item that was never marked do nothing.
    """
    return slices.by_group_size(log, ["user_id", "question_id"], max_group, replay_short, replay_long)


def replay_short(log: DataFrame) -> DataFrame:
    kind = (
        "struct<reason:string,note:string,session_id:bigint,created_at:bigint,updated_at:bigint,"
        "resolved_at:bigint,times_marked:bigint>"
    )

    def step(acc: Column, e: Column) -> Column:
        at = e["at"]
        again = mark(acc, e["reason"], e["session_id"], at)
        toggled = F.when(acc["resolved_at"].isNull(), with_resolved(acc, at, at)).otherwise(
            mark(acc, acc["reason"], acc["session_id"], at)
        )
        return (
            F.when(e["action"] == "mark", again)
            .when(acc.isNull(), acc)
            .when(e["action"] == "resolve", with_resolved(acc, at, at))
            .when(e["action"] == "unresolve", with_resolved(acc, F.lit(None), at))
            .when(e["action"] == "edit", edit(acc, e["reason"], F.lit(None).cast("string"), at))
            .otherwise(toggled)
            .cast(kind)
        )

    events = F.array_sort(F.collect_list(F.struct("at", "seq", "action", "reason", "session_id")))
    folded = log.groupBy("user_id", "question_id").agg(
        F.aggregate(events, F.lit(None).cast(kind), step).alias("_m")
    )
    return folded.filter("_m is not null").select("user_id", "question_id", "_m.*")


def replay_long(log: DataFrame, slice_ms: int = fx.DAY_MS) -> DataFrame:
    """The same replay for items with very long logs, as running counts over time slices.

    Every action but `toggle` sets the open/resolved state outright, so the state after an event is
    the last setter's state flipped by the toggles since; everything else is a first, a last or a
    count of events.
    """
    keys, order = ["user_id", "question_id"], ["at", "seq"]
    when = F.struct(*order)
    is_mark = F.col("action") == "mark"
    born = log.filter(is_mark).groupBy(*keys).agg(F.min(when).alias("_born"))
    e = log.join(born, keys).filter(when >= F.col("_born")).withColumn("_slice", F.floor(F.col("at") / slice_ms))
    toggle = F.col("action") == "toggle"
    e = slices.running_sum(e, keys, "_slice", order, {"_t": toggle.cast("bigint")})
    setter = F.when(~toggle, F.struct((F.col("action") == "resolve").alias("resolved"), F.col("_t").alias("t")))
    e = slices.carry_start(e.withColumn("_set", setter), keys, "_slice", order, ~toggle, "_set", "_last")
    e = e.withColumn("_resolved", F.col("_last.resolved") != ((F.col("_t") - F.col("_last.t")) % 2 == 1))
    e = materialize(e.drop("_t", "_set", "_last"), "long-mark-logs")
    e = slices.neighbours(e, keys, "_slice", order, lag={"_was": "_resolved"})
    counts = (is_mark | toggle) & F.coalesce("_was", F.lit(True))
    # an edit without a reason keeps the one before
    sets_reason = is_mark | ((F.col("action") == "edit") & F.col("reason").isNotNull())
    out = e.groupBy(*keys).agg(
        F.max_by("reason", F.when(sets_reason, when)).alias("reason"),
        F.max_by("session_id", F.when(is_mark, when)).alias("session_id"),
        F.min("at").alias("created_at"),
        F.max("at").alias("updated_at"),
        F.max_by("_resolved", when).alias("_end"),
        F.count_if(counts).alias("times_marked"),
    )
    # whatever resolved the mark was its last event
    resolved = F.when(F.col("_end"), F.col("updated_at"))
    return out.withColumn("note", F.lit("")).withColumn("resolved_at", resolved).select(*keys, *MARK)


def marks_by_reason(marks: DataFrame) -> DataFrame:
    """Open marks per user and reason, zero where a reason is absent."""
    counts = [F.count_if(F.col("reason") == r).alias(r) for r in fx.REASONS]
    return marks.filter("resolved_at is null").groupBy("user_id").agg(*counts, F.count("*").alias("open_total"))


def marks_by_topic(marks: DataFrame, questions: DataFrame) -> DataFrame:
    """Open marks per user and primary topic, most frequent first."""
    bank = questions.select("question_id", primary().alias("slug")).filter("slug is not null")
    counts = (
        marks.filter("resolved_at is null").join(bank, "question_id").groupBy("user_id", "slug").agg(F.count("*").alias("n"))
    )
    # at most one row per topic and user
    w = W.partitionBy("user_id").orderBy(F.desc("n"), "slug")
    return counts.withColumn("rank", F.row_number().over(w))


def open_marks(marks: DataFrame) -> DataFrame:
    return marks.filter("resolved_at is null").select("user_id", "question_id", "reason", "created_at")


def filter_marks(marks: DataFrame, questions: DataFrame, status: str = "all", reason: str | None = None) -> DataFrame:
    """Known marks by status (`open`, `resolved`, `all`) and reason."""
    m = marks.join(questions.select("question_id"), "question_id", "left_semi")
    if status != "all":
        m = m.filter("resolved_at is null" if status == "open" else "resolved_at is not null")
    return m if reason is None else m.filter(F.col("reason") == reason)
