"""The SM-2 step and its ordered fold as native expressions.

The state struct is (repetitions, interval_days, ease_factor, last_reviewed_at). Intervals are
DOUBLE: a long streak multiplies them past any integer type. The ease moves in whole hundredths, so
every path (fold, running sums, stream) gets the same number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import DAY_MS, col, half_up

# Fixed values of the algorithm.
START_EASE = 2.5
MIN_EASE = 1.3

_MAX_DUE = 9.0e18  # keeps a runaway interval inside BIGINT milliseconds


def initial_state() -> Column:
    return state(F.lit(0).cast("bigint"), F.lit(1.0), F.lit(START_EASE), F.lit(0).cast("bigint"))


def state(repetitions, interval, ease, last) -> Column:
    return F.struct(
        col(repetitions).alias("repetitions"),
        col(interval).alias("interval_days"),
        col(ease).alias("ease_factor"),
        col(last).alias("last_reviewed_at"),
    )


def step(prev: Column, quality: Column, now: Column) -> Column:
    """One review: quality 0..5 applied to the previous state."""
    q = F.least(F.lit(5), F.greatest(F.lit(0), quality)).cast("bigint")
    hundredths = F.round(prev["ease_factor"] * 100).cast("bigint") + ease_change(q)
    ease = F.greatest(F.lit(round(MIN_EASE * 100)), hundredths) / 100
    lapse = q < 3
    reps = F.when(lapse, F.lit(0).cast("bigint")).otherwise(prev["repetitions"] + 1)
    interval = (
        F.when(lapse | (prev["repetitions"] == 0), F.lit(1.0))
        .when(prev["repetitions"] == 1, F.lit(6.0))
        # round half up in floating point: the product may exceed BIGINT
        .otherwise(grow(prev["interval_days"], ease))
    )
    return state(reps, interval, ease, now.cast("bigint"))


def ease_change(q: Column) -> Column:
    """What a quality adds to the ease, in whole hundredths: sums are exact in any order."""
    gap = F.lit(5) - q
    return (F.lit(10) - gap * (F.lit(8) + gap * F.lit(2))).cast("bigint")


def grow(interval: Column, ease: Column) -> Column:
    """The next interval of a run, rounded half up."""
    x = interval * ease
    # beyond 2^52 doubles are whole numbers already, and floor() would leave the BIGINT range
    return F.when(x < 4.5e15, F.floor(x + F.lit(0.5)).cast("double")).otherwise(x)


def fold(events: Column, init: Column | None = None) -> Column:
    """Fold an array of (t, seq, q) structs in time order."""
    return F.aggregate(
        F.array_sort(events), initial_state() if init is None else init, lambda acc, e: step(acc, e["q"], e["t"])
    )


def due_at(interval: Column, last: Column) -> Column:
    return F.least(last + interval * F.lit(float(DAY_MS)), F.lit(_MAX_DUE)).cast("bigint")


def quality_from_outcome(correct, unsure) -> Column:
    return F.when(~col(correct), F.lit(1)).when(col(unsure), F.lit(3)).otherwise(F.lit(4))


def quality_from_accuracy(correct, total) -> Column:
    """Laplace-damped accuracy on the 0..5 scale."""
    return half_up((col(correct) + 1) / (col(total) + 2) * 5).cast("int")
