"""Interval join: points of a key with the intervals of that key that contain them.

Time is cut into buckets at levels, each eight times as wide as the one below. An interval stands at the lowest level whose
buckets are at least as long as it is, so it lies in two buckets of that level at most; a point looks into one bucket of
each level in use (at most 21). So the join is an equi-join on (key, level, bucket) with a test of containment, short
intervals never meet points far from them, and a key with very many points spreads over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

STEP = 3  # bits from level to level
TOP = 20  # open intervals


def level(start: Column, end: Column) -> Column:
    """The lowest level with 8**level >= end - start; open intervals stand at the top."""
    sized = F.ceil(F.log2((end - start).cast("double")) / STEP)
    return F.when(end.isNull(), TOP).otherwise(F.greatest(F.lit(0), F.least(F.lit(TOP), sized))).cast("int")


def bucket(at: Column, lv: Column) -> Column:
    return F.call_function("shiftright", at, lv * STEP)


def contain(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str) -> DataFrame:
    """Every pair of a point and an interval of its key with start <= at < end; a null `end` is open.

    `at`, `start` and `end` are BIGINT. Null keys or times meet nothing; an interval that ends before it starts holds no
    point. Columns of both sides are kept, keys once; other names must differ.
    """
    ranges = intervals.filter(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) > F.col(start))))
    ranges = ranges.withColumn("_level", level(F.col(start), F.col(end)))
    first, last = bucket(F.col(start), F.col("_level")), bucket(F.col(end) - 1, F.col("_level"))
    # an open interval also lies in all later buckets of the top level, of which the last is 7
    last = F.when(F.col(end).isNull(), F.lit(7).cast("bigint")).otherwise(last)
    ranges = ranges.withColumn("_bucket", F.explode(F.sequence(first, last)))
    ranges = materialize(ranges, "interval-buckets")
    levels = sorted(r["_level"] for r in ranges.select("_level").distinct().collect())  # at most 21
    probe = points.filter(F.col(at).isNotNull()).withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    probe = probe.withColumn("_bucket", bucket(F.col(at), F.col("_level")))
    pairs = probe.join(ranges, [*keys, "_level", "_bucket"])
    return pairs.filter((F.col(start) <= F.col(at)) & (F.col(end).isNull() | (F.col(at) < F.col(end)))).drop("_level", "_bucket")


def latest(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, ident: list[str], start: str, end: str,
           take: list[str]) -> DataFrame:
    """Each point with the columns `take` of the interval that started last of those that contain it, null if none does.

    `ident` names a point; intervals that start together are told apart by `take`.
    """
    best = contain(points.select(*keys, at, *ident), intervals, keys, at, start, end)
    best = best.groupBy(*ident).agg(F.max(F.struct(start, *[c for c in take if c != start])).alias("_best"))
    return points.join(best, ident, "left").select(*points.columns, *[F.col(f"_best.{c}").alias(c) for c in take])
