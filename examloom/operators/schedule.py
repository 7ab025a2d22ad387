"""Spaced-repetition schedules: per-session updates, upserts, rebuild from history, agendas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import core as fx
from ..functions import sm2
from ..session import materialize
from . import slices
from .scoring import primary

DAILY_LIMIT = 20

STATE = ["repetitions", "interval_days", "ease_factor", "due_at", "last_reviewed_at"]


def _prior():
    """Prior state taken from nullable columns of a left join, or the starting state."""
    return sm2.state(
        F.coalesce("repetitions", F.lit(0).cast("bigint")).cast("bigint"),
        F.coalesce(F.col("interval_days").cast("double"), F.lit(1.0)),
        F.coalesce("ease_factor", F.lit(sm2.START_EASE)),
        F.coalesce("last_reviewed_at", F.lit(0).cast("bigint")),
    )


def _expand(df: DataFrame, keep: list[str], s: str = "_s") -> DataFrame:
    st = F.col(s)
    return df.select(
        *keep,
        st["repetitions"].alias("repetitions"),
        st["interval_days"].alias("interval_days"),
        st["ease_factor"].alias("ease_factor"),
        sm2.due_at(st["interval_days"], st["last_reviewed_at"]).alias("due_at"),
        st["last_reviewed_at"].alias("last_reviewed_at"),
    )


def item_outcomes(graded: DataFrame) -> DataFrame:
    """Outcomes (t, seq, q) of the answered items of finished sessions."""
    answered = graded.filter("finished_at is not null and response is not null")
    return answered.select(
        "user_id", "question_id", F.col("finished_at").alias("t"), F.struct("session_id", "pos").alias("seq"),
        sm2.quality_from_outcome("correct", "flagged").alias("q"),
    )


def apply_outcomes(old: DataFrame, outcomes: DataFrame, keys: list[str], max_group: int | None = None) -> DataFrame:
    """The schedule after a batch: each key's new outcomes (t, seq, q) folded in order from its stored state.

    Several sessions of one batch step from the state that the one before left. One row per key; keys
    without new outcomes keep their row. A key with more than `max_group` outcomes goes through
    :func:`rebuild_long` with its stored state as the start, so no batch is gathered whole.
    """
    stored = old.select(*keys, *STATE)

    def short(df: DataFrame) -> DataFrame:
        new = df.groupBy(*keys).agg(F.collect_list(F.struct("t", "seq", "q")).alias("_new"))
        return _expand(new.join(stored, keys, "left").withColumn("_s", sm2.fold(F.col("_new"), _prior())), keys)

    def long(df: DataFrame) -> DataFrame:
        return rebuild_long(df, keys, start=stored).select(*keys, *STATE)

    limit = MAX_GROUP if max_group is None else max_group
    after = slices.by_group_size(outcomes, keys, limit, short, long).select(*keys, F.struct(*STATE).alias("_after"))
    before = stored.select(*keys, F.struct(F.col("repetitions").cast("bigint").alias("repetitions"),
                           F.col("interval_days").cast("double").alias("interval_days"), *STATE[2:]).alias("_before"))
    return before.join(after, keys, "full_outer").select(*keys, F.coalesce("_after", "_before").alias("_v")).select(*keys, "_v.*")


def srs_updates(graded: DataFrame, srs: DataFrame) -> DataFrame:
    """Next item schedule for every answered item of a finished session, from the stored state.

    For sessions that are applied one at a time; :func:`apply_outcomes` applies several at once.
    """
    answered = graded.filter("finished_at is not null and response is not null").select(
        "user_id", "session_id", "pos", "question_id", "correct", "flagged", "finished_at"
    )
    prior = srs.select("user_id", "question_id", "repetitions", "interval_days", "ease_factor", "last_reviewed_at")
    q = sm2.quality_from_outcome("correct", "flagged")
    stepped = answered.join(prior, ["user_id", "question_id"], "left").withColumn(
        "_s", sm2.step(_prior(), q, F.col("finished_at"))
    )
    return _expand(stepped, ["user_id", "session_id", "pos", "question_id"])


def topic_tally(graded: DataFrame) -> DataFrame:
    """Answered, non-annulled items per (session, primary topic); flagged hits do not count as correct."""
    return (
        graded.filter("finished_at is not null and response is not null and not annulled")
        .withColumn("slug", primary())
        .filter("slug is not null")
        .groupBy("user_id", "session_id", "finished_at", "slug")
        .agg(F.count("*").alias("total"), F.count_if(F.col("correct") & ~F.col("flagged")).alias("correct"))
    )


def topic_srs_updates(tally: DataFrame, topic_srs: DataFrame) -> DataFrame:
    prior = topic_srs.select("user_id", "slug", "repetitions", "interval_days", "ease_factor", "last_reviewed_at")
    q = sm2.quality_from_accuracy("correct", "total")
    stepped = (
        tally.join(prior, ["user_id", "slug"], "left")
        .withColumn("_s", sm2.step(_prior(), q, F.col("finished_at")))
        .withColumn("last_accuracy", F.coalesce(fx.ratio("correct", "total"), F.lit(0.0)))
    )
    return _expand(stepped, ["user_id", "session_id", "slug", "last_accuracy"])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """New rows replace old ones by key; among new rows the greatest `order` wins.

    One aggregate over the union, no join. Over structs Spark sorts each task's rows first.
    """
    cols = [c for c in old.columns if c not in keys]
    rank = F.struct(F.lit(1), *[F.col(c).cast("bigint") for c in order])
    zero = F.struct(F.lit(0), *[F.lit(None).cast("bigint").alias(c) for c in order])
    both = new.select(*keys, F.struct(*cols).alias("_v"), rank.alias("_o")).union(
        old.select(*keys, F.struct(*cols).alias("_v"), zero.alias("_o"))
    )
    return both.groupBy(*keys).agg(F.max_by("_v", "_o").alias("_v")).select(*keys, "_v.*")


MAX_GROUP = 100_000
DAY = fx.DAY_MS
# An unbroken run multiplies its interval by 1.3 or more each time: after 2,710 steps it is past the
# largest double, so the first rows of a run decide its interval whatever follows.
MAX_RUN = 3_000


def rebuild(outcomes: DataFrame, keys: list[str], max_group: int = MAX_GROUP) -> DataFrame:
    """Replay all outcomes (`t`, `seq`, `q`) of each key in time order.

    Keys of ordinary size fold their outcomes as one array; larger ones go through
    :func:`rebuild_long`, which never gathers a key in one place.
    """
    return slices.by_group_size(
        outcomes, keys, max_group, lambda df: rebuild_short(df, keys), lambda df: rebuild_long(df, keys)
    )


def rebuild_short(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    folded = outcomes.groupBy(*keys).agg(
        sm2.fold(F.collect_list(F.struct("t", "seq", "q"))).alias("_s"), F.count("*").alias("reviews")
    )
    return _expand(folded, [*keys, "reviews"])


def rebuild_long(outcomes: DataFrame, keys: list[str], slice_ms: int = DAY, start: DataFrame | None = None) -> DataFrame:
    """The same replay as running sums and minima over time slices, from the stored states `start` (keys, state) if given.

    Ease is a sum of steps reflected at its floor, so in whole hundredths
    ``ease(n) = D(n) + max(start, floor - min(D))`` with D the running sum of the steps. Intervals
    depend only on the run of successes after the last lapse, and only its first MAX_RUN rows can
    matter; those are the only rows gathered.
    """
    q = F.least(F.lit(5), F.greatest(F.lit(0), F.col("q")))
    change = sm2.ease_change(q)
    floor, fresh = round(sm2.MIN_EASE * 100), round(sm2.START_EASE * 100)
    order = ["t", "seq"]
    rows = outcomes.select(*keys, *order, q.alias("q")).withColumn("_slice", F.floor(F.col("t") / slice_ms))
    rows = slices.running_sum(rows, keys, "_slice", order, {"_d": change})
    rows = slices.running_min(rows, keys, "_slice", order, {"_low": F.col("_d")})
    reps, days, ease = F.lit(0).cast("bigint"), F.lit(1.0), F.lit(fresh)
    if start is not None:
        kept = start.select(*keys, F.col("repetitions").alias("_r0"), F.col("interval_days").alias("_i0"), F.col("ease_factor").alias("_e0"))
        rows = rows.join(kept, keys, "left")
        reps, days = F.coalesce(F.col("_r0").cast("bigint"), reps), F.coalesce(F.col("_i0").cast("double"), days)
        ease = F.coalesce(F.round(F.col("_e0") * 100).cast("bigint"), ease)
    rows = rows.withColumn("_ease", (F.col("_d") + F.greatest(ease, floor - F.col("_low"))) / 100)
    rows = rows.withColumn("_base", reps).withColumn("_from", days)
    rows = materialize(rows.select(*keys, *order, "q", "_slice", "_ease", "_base", "_from"), "long-histories")
    at = F.struct(*order)
    ends = rows.groupBy(*keys).agg(
        F.count("*").alias("reviews"),
        F.max_by(F.struct(F.col("t").alias("last_reviewed_at"), "_ease"), at).alias("_end"),
        F.max(F.when(F.col("q") < 3, at)).alias("_lapse"),
    )
    run = rows.join(ends.select(*keys, "_lapse"), keys).filter(F.col("_lapse").isNull() | (at > F.col("_lapse")))
    # a run since a lapse starts anew, another one goes on from the stored state
    anew = F.col("_lapse").isNotNull()
    run = run.withColumn("_base", F.when(anew, F.lit(0).cast("bigint")).otherwise(F.col("_base")))
    run = run.withColumn("_from", F.when(anew, 1.0).otherwise(F.col("_from"))).drop("_lapse", "q")
    run = slices.rank(run, keys, "_slice", order, out="_r", total="_total").filter(F.col("_r") <= MAX_RUN)
    grown = run.groupBy(*keys).agg(
        (F.max("_base") + F.max("_total")).alias("repetitions"),
        F.aggregate(
            F.array_sort(F.collect_list(F.struct("_r", "_ease", "_base"))),
            F.max("_from"),
            lambda acc, e: F.when(e["_base"] + e["_r"] == 1, F.lit(1.0)).when(e["_base"] + e["_r"] == 2, F.lit(6.0)).otherwise(sm2.grow(acc, e["_ease"])),
        ).alias("_interval"),
        F.max("_total").alias("_total"),
    )
    interval = F.when(F.col("_total") > MAX_RUN, F.lit(float("inf"))).otherwise(F.coalesce("_interval", F.lit(1.0)))
    state = sm2.state(
        F.coalesce("repetitions", F.lit(0).cast("bigint")), interval, F.col("_end._ease"), F.col("_end.last_reviewed_at")
    )
    return _expand(ends.join(grown, keys, "left").withColumn("_s", state), [*keys, "reviews"])


def due(
    srs: DataFrame, now: int, keys=("user_id",), limit: int = DAILY_LIMIT, item="question_id", bank: DataFrame | None = None
) -> DataFrame:
    """Due rows, most overdue first, capped per user; `due_total` is the uncapped count.

    With a bank, items that it lacks are neither served nor counted, and ties follow its order. The cap is a per-user rank, which Spark turns into a group limit before the shuffle.
    """
    d = srs.filter(F.col("due_at") <= now)
    if bank is not None:
        d = d.join(bank.select(item, "bank_pos"), item)
    w = W.partitionBy(*keys).orderBy("due_at", *([] if bank is None else ["bank_pos"]), item)
    top = d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    totals = d.groupBy(*keys).agg(F.count("*").alias("due_total"))
    return top.select(*keys, item, "due_at", "rank").join(totals, list(keys))


def agenda(srs: DataFrame, now: int) -> DataFrame:
    """Per user: tracked, due, scheduled later, and days until the next not-yet-due entry."""
    later = F.when(F.col("due_at") > now, F.col("due_at"))
    return (
        srs.groupBy("user_id")
        .agg(F.count("*").alias("tracked"), F.count_if(F.col("due_at") <= now).alias("due"), F.min(later).alias("_next"))
        .select("user_id", "tracked", "due", fx.days_until("_next", now).alias("next_in_days"))
        .withColumn("next_in_days", F.when(F.col("tracked") > F.col("due"), F.col("next_in_days")))
    )
