"""Topic incidence, trend, accuracy and study priority."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import core as fx
from ..session import materialize

# How many latest exams count as recent, minimum answers, assumed accuracy.
RECENT_EXAMS = 5
MIN_ANSWERS = 4
ASSUMED_ACCURACY = 0.5


def topic_rows(questions: DataFrame) -> DataFrame:
    """One row per (item, topic); `tpos` 0 is the primary topic."""
    return questions.select("question_id", "year", "area", "annulled", F.posexplode("topics").alias("tpos", "slug"))


def _exam_scalars(questions: DataFrame):
    """Exam count and the set of recent years as scalar subqueries over the distinct years."""
    years = questions.select("year").distinct()
    n = years.agg(F.greatest(F.count("*"), F.lit(1))).scalar()
    recent = years.agg(F.slice(F.sort_array(F.collect_set("year"), asc=False), 1, RECENT_EXAMS)).scalar()
    return n, recent


def _derive(counts: DataFrame) -> DataFrame:
    """Rates and priority from counts; needs exam_count and recent_count columns."""
    out = counts.withColumn("per_exam", F.col("primary_count") / F.col("exam_count"))
    out = out.withColumn("per_exam_recent", F.col("recent_primary") / F.col("recent_count"))
    out = out.withColumn("trend", F.col("per_exam_recent") - F.col("per_exam"))
    out = out.withColumn("accuracy", F.when(F.col("answered") >= MIN_ANSWERS, fx.ratio("correct", "answered")))
    expected = (F.col("per_exam") + 2 * F.col("per_exam_recent")) / 3
    out = out.withColumn("expected", expected)
    out = out.withColumn("priority", F.col("expected") * (1 - F.coalesce("accuracy", F.lit(ASSUMED_ACCURACY))))
    return out.withColumn("priority_is_estimate", F.col("accuracy").isNull())


def _incidence(questions: DataFrame, extra=()) -> DataFrame:
    _, recent = _exam_scalars(questions)
    return (
        F.count_if(F.col("tpos") == 0).alias("primary_count"),
        F.count("tpos").alias("total_count"),
        F.count_if((F.col("tpos") == 0) & F.array_contains(recent, F.col("year"))).alias("recent_primary"),
        *extra,
    )


def _with_exam_counts(df: DataFrame, questions: DataFrame) -> DataFrame:
    n, recent = _exam_scalars(questions)
    return df.withColumn("exam_count", n).withColumn("recent_count", F.greatest(F.size(recent), F.lit(1)))


STAT_COLUMNS = [
    "slug", "label", "area", "primary_count", "total_count", "per_exam", "per_exam_recent", "trend",
    "answered", "correct", "accuracy", "priority", "priority_is_estimate",
]


def topic_stats(questions: DataFrame, topics: DataFrame, latest: DataFrame) -> DataFrame:
    """One row per topic, zero rows kept. `latest` holds one attempt per item.

    The nested topics x items loop becomes one explode and one aggregate per topic.
    """
    rows = topic_rows(questions).join(latest.select("question_id", "answer", "correct"), "question_id", "left")
    counted = rows.groupBy("slug").agg(
        *_incidence(
            questions,
            (
                F.count("answer").alias("answered"),
                F.count_if(F.col("answer").isNotNull() & F.col("correct")).alias("correct"),
            ),
        )
    )
    zeros = ["primary_count", "total_count", "recent_primary", "answered", "correct"]
    joined = topics.join(counted, "slug", "left").fillna(0, zeros)
    return _derive(_with_exam_counts(joined, questions)).select(*STAT_COLUMNS)


def default_stats(questions: DataFrame, topics: DataFrame) -> DataFrame:
    """The topic table of somebody without any history: what every user's untouched topics share."""
    zero = F.lit(0).cast("bigint")
    counted = topic_rows(questions).groupBy("slug").agg(*_incidence(questions))
    joined = topics.join(counted, "slug", "left").fillna(0, ["primary_count", "total_count", "recent_primary"])
    joined = joined.withColumn("answered", zero).withColumn("correct", zero)
    return _derive(_with_exam_counts(joined, questions)).select(*STAT_COLUMNS)


def user_topic_stats(questions: DataFrame, topics: DataFrame, latest: DataFrame) -> DataFrame:
    """The topic table's rows for every (user, topic) that the user has answered; all others are as in `default_stats`."""
    rows = topic_rows(questions)
    incidence = topics.join(rows.groupBy("slug").agg(*_incidence(questions)), "slug")
    touched = (
        latest.filter("answer is not null")
        .select("user_id", "question_id", "correct")
        .join(rows.select("question_id", "slug"), "question_id")
        .groupBy("user_id", "slug")
        .agg(F.count("*").alias("answered"), F.count_if("correct").alias("correct"))
    )
    joined = touched.join(incidence, "slug")
    return _derive(_with_exam_counts(joined, questions)).select("user_id", *STAT_COLUMNS)


def user_top(users: DataFrame, touched: DataFrame, defaults: DataFrame, key: str, n: int, area: str | None = None,
             occurring: bool = True) -> DataFrame:
    """The first `n` rows of each user's topic table under a sort key, with their `rank`.

    No user meets the whole taxonomy. The untouched topics stand in one order for everybody, so a user's best untouched
    ones are the first `n` places of it that the user has not touched: with t(j) the place of the j-th touched topic,
    those with t(j) - j < n come before the n-th untouched one, and so many places have to be read on. These and the
    touched topics are merged: n + touched rows per user. `occurring` leaves out topics without items.
    """
    def shown(stats: DataFrame) -> DataFrame:
        stats = stats.filter("total_count > 0") if occurring else stats
        return stats if area is None else stats.filter(F.col("area") == area)

    # taxonomy-sized, one order for all users
    places = shown(defaults).withColumn("_t", F.row_number().over(W.orderBy(*sort_keys(key))))
    places = materialize(places, "topic-places")
    mine = shown(touched).join(places.select("slug", "_t"), "slug")
    j = F.row_number().over(W.partitionBy("user_id").orderBy("_t"))
    before = mine.select("user_id", "_t", j.alias("_j")).filter(F.col("_t") - F.col("_j") < n)
    before = before.groupBy("user_id").agg(F.collect_list("_t").alias("_ts"))  # at most the taxonomy
    none = F.array().cast("array<int>")
    open_ = users.select("user_id").join(before, "user_id", "left").withColumn("_ts", F.coalesce("_ts", none))
    free = F.array_except(F.sequence(F.lit(1), F.lit(n) + F.size("_ts")), "_ts")
    open_ = open_.select("user_id", F.explode(free).alias("_t")).join(places, "_t").drop("_t")
    both = open_.select("user_id", *STAT_COLUMNS).unionByName(mine.select("user_id", *STAT_COLUMNS))
    rank = F.row_number().over(W.partitionBy("user_id").orderBy(*sort_keys(key)))
    return both.withColumn("rank", rank).filter(F.col("rank") <= n)


def user_chart(users: DataFrame, touched: DataFrame, defaults: DataFrame, key: str = "priority", n: int = 12,
               area: str | None = None) -> DataFrame:
    """`chart_rows` of every user."""
    value = F.col("per_exam_recent" if key == "recent" else "per_exam")
    top = user_top(users, touched, defaults, key, n, area).withColumn("value", value)
    peak = F.greatest(F.lit(1.0), F.max("value").over(W.partitionBy("user_id")))
    return top.select("user_id", "rank", "slug", "label", "area", "value", (F.col("value") / peak).alias("bar"))


def user_study_plan(users: DataFrame, touched: DataFrame, defaults: DataFrame, n: int = 3) -> DataFrame:
    """`study_plan` of every user. The total starts from the one of the untouched table and is corrected by what is touched."""
    exact = F.col("priority").cast("decimal(20,12)")  # leaves the sums their digits
    touched = materialize(touched, "touched")
    base = defaults.agg(F.coalesce(F.sum(exact), F.lit(0).cast("decimal(30,12)"))).scalar()
    change = touched.select("user_id", "slug", exact.alias("now")).join(defaults.select("slug", exact.alias("was")), "slug")
    change = change.groupBy("user_id").agg(F.sum(F.col("now") - F.col("was")).alias("_change"))
    top = user_top(users, touched, defaults, "priority", n, occurring=False).join(change, "user_id", "left")
    total = base + F.coalesce("_change", F.lit(0).cast("decimal(30,12)"))
    floor = F.greatest(F.lit(0.01), F.max("priority").over(W.partitionBy("user_id")))
    return top.select(
        "user_id", "rank", "slug", "label", "priority", "priority_is_estimate", total.cast("double").alias("total_priority"),
        (F.col("priority") / floor).alias("bar"),
    )


def sort_keys(key: str) -> list:
    """Sort expressions of the topic table; topics without history go last under `accuracy`."""
    column = {
        "priority": "priority",
        "incidence": "primary_count",
        "recent": "per_exam_recent",
        "trend": "trend",
        "accuracy": "accuracy",
    }[key]
    first = F.asc_nulls_last(column) if key == "accuracy" else F.desc(column)
    return [first, F.asc("slug")]


def rank_topics(stats: DataFrame, key: str, area: str | None = None) -> DataFrame:
    """The topic table under one sort key: topics that occur, optionally of one area."""
    shown = stats.filter("total_count > 0")
    if area is not None:
        shown = shown.filter(F.col("area") == area)
    # one row per taxonomy entry: a single-partition rank over a dimension-sized table
    return shown.withColumn("rank", F.row_number().over(W.orderBy(*sort_keys(key))))


def all_rankings(stats: DataFrame) -> DataFrame:
    """Every sort order of the topic table in one pass over the statistics (long form)."""
    keys = ["priority", "incidence", "recent", "trend", "accuracy"]
    shown = stats.filter("total_count > 0").select(
        "slug", *[F.row_number().over(W.orderBy(*sort_keys(k))).alias(k) for k in keys]
    )
    return shown.unpivot(["slug"], keys, "sort_key", "rank")


def chart_rows(stats: DataFrame, key: str = "priority", n: int = 12) -> DataFrame:
    value = F.col("per_exam_recent" if key == "recent" else "per_exam")
    top = rank_topics(stats, key).filter(F.col("rank") <= n).withColumn("value", value)
    return top.withColumn("bar", F.col("value") / F.greatest(F.lit(1.0), F.max("value").over(W.partitionBy()))).select(
        "rank", "slug", "label", "area", "value", "bar"
    )


def study_plan(stats: DataFrame, n: int = 3) -> DataFrame:
    """Top topics by priority with their share of the total and a normalised bar."""
    total = stats.agg(F.sum(F.col("priority").cast("decimal(38,12)"))).scalar().cast("double")
    ranked = stats.withColumn("rank", F.row_number().over(W.orderBy(*sort_keys("priority"))))
    top = ranked.filter(F.col("rank") <= n)
    floor = F.greatest(F.lit(0.01), F.max("priority").over(W.partitionBy()))
    return top.select(
        "rank", "slug", "priority", total.alias("total_priority"), (F.col("priority") / floor).alias("bar")
    )


def topic_years(questions: DataFrame) -> DataFrame:
    """Primary-topic counts per exam year (long form), with each topic's scale maximum."""
    counts = (
        topic_rows(questions).filter("tpos = 0").groupBy("slug", "year").agg(F.count("*").alias("n"))
    )
    peak = counts.groupBy("slug").agg(F.greatest(F.max("n"), F.lit(1)).alias("peak"))
    return counts.join(peak, "slug")


def topic_year_matrix(questions: DataFrame, years: list[int] | None = None) -> DataFrame:
    """Wide form of :func:`topic_years`: one column per exam year, of all years in the items unless a list is given."""
    if years is None:  # as many as there are exams
        years = sorted(r.year for r in questions.select("year").distinct().collect())
    return (
        topic_rows(questions)
        .filter("tpos = 0")
        .groupBy("slug")
        .pivot("year", years)
        .count()
        .fillna(0)
    )


def coverage(questions: DataFrame) -> DataFrame:
    return questions.agg(
        F.count_if(F.size("topics") == 0).alias("count"), F.count("*").alias("total")
    ).withColumn("coverage", F.coalesce(fx.ratio(F.col("total") - F.col("count"), "total"), F.lit(1.0)))


def topic_report(questions: DataFrame, topics: DataFrame) -> DataFrame:
    """Items per topic as primary, as any, and primary share of the exam in percent."""
    counts = topic_rows(questions).groupBy("slug").agg(
        F.count_if(F.col("tpos") == 0).alias("primary_count"), F.count("*").alias("any_count")
    )
    total = questions.agg(F.count("*")).scalar()
    return (
        topics.join(counts, "slug", "left")
        .fillna(0, ["primary_count", "any_count"])
        .select("slug", "label", "primary_count", "any_count", (100 * F.col("primary_count") / total).alias("pct_exam"))
    )


def topic_pool(questions: DataFrame, selections: DataFrame) -> DataFrame:
    """How many items touch any topic of each selection (`selection_id`, `slug` rows)."""
    return (
        topic_rows(questions)
        .join(selections, "slug")
        .groupBy("selection_id")
        .agg(F.count_distinct("question_id").alias("pool"))
    )


def topic_bucket(questions: DataFrame, selected: list[str]) -> DataFrame:
    """The first of an item's topics that is selected; items touching none are dropped."""
    sel = F.array(*[F.lit(s) for s in selected])
    bucket = F.try_element_at(F.filter("topics", lambda t: F.array_contains(sel, t)), F.lit(1))
    return questions.filter(F.arrays_overlap("topics", sel)).select("question_id", bucket.alias("bucket"))
