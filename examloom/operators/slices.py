"""Ordered computations (rank, lag, lead, running sum) over groups of any size.

A plain window puts a whole group into one task, which fails when one group holds a large share
of the rows. Here a group is cut into slices that follow the sort order (a day of events, a page
of words, a bucket of a hash); the window runs per (group, slice), and one small row per slice
carries what the neighbouring slices need. A slice must be a function of the leading sort key, so
that slices never interleave.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize


def _w(keys, order):
    return W.partitionBy(*keys).orderBy(*order)


def rank(df: DataFrame, keys: list[str], slice_col: str, order: list, out: str = "rank", total: str | None = None) -> DataFrame:
    """1-based row number per group (and optionally the group size) as BIGINT."""
    counts = df.groupBy(*keys, slice_col).agg(F.count("*").alias("_c"))
    w = _w(keys, [slice_col])
    counts = counts.withColumn(
        "_before", F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_c")
    )
    cols = [*keys, slice_col, "_before"]
    if total:
        counts = counts.withColumn(total, F.sum("_c").over(W.partitionBy(*keys)))
        cols.append(total)
    local = df.withColumn("_rn", F.row_number().over(_w([*keys, slice_col], order)).cast("bigint"))
    joined = local.join(counts.select(*cols), [*keys, slice_col])
    return joined.withColumn(out, F.col("_rn") + F.col("_before")).drop("_rn", "_before")


def _running(df, keys, slice_col, order, values, fn, combine):
    tmp = {f"_v_{k}": v for k, v in values.items()}
    base = df.select("*", *[v.alias(k) for k, v in tmp.items()])
    per = base.groupBy(*keys, slice_col).agg(*[fn(k).alias(f"_s{k}") for k in tmp])
    before = _w(keys, [slice_col]).rowsBetween(W.unboundedPreceding, -1)
    offsets = per.select(*keys, slice_col, *[fn(f"_s{k}").over(before).alias(f"_o{k}") for k in tmp])
    lw = _w([*keys, slice_col], order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = base.select("*", *[fn(k).over(lw).alias(f"_l{k}") for k in tmp])
    joined = local.join(offsets, [*keys, slice_col])
    return joined.select(*df.columns, *[combine(F.col(f"_l_v_{k}"), F.col(f"_o_v_{k}")).alias(k) for k in values])


def running_sum(df: DataFrame, keys: list[str], slice_col: str, order: list, values: dict[str, Column]) -> DataFrame:
    """Inclusive running sums per group, one output column per entry of `values`."""
    return _running(df, keys, slice_col, order, values, F.sum, lambda here, before: here + F.coalesce(before, F.lit(0)))


def running_min(df: DataFrame, keys: list[str], slice_col: str, order: list, values: dict[str, Column]) -> DataFrame:
    """Inclusive running minima per group."""
    return _running(df, keys, slice_col, order, values, F.min, lambda here, before: F.least(here, before))


def running_xor(df: DataFrame, keys: list[str], slice_col: str, order: list, values: dict[str, Column]) -> DataFrame:
    """Inclusive running bitwise XORs per group, as for hashes of prefixes."""
    return _running(df, keys, slice_col, order, values, F.bit_xor, lambda here, before: here.bitwiseXOR(F.coalesce(before, F.lit(0))))


def neighbours(
    df: DataFrame,
    keys: list[str],
    slice_col: str,
    order: list[str],
    lag: dict[str, str] | None = None,
    lead: dict[str, str] | None = None,
) -> DataFrame:
    """Values of the previous (`lag`) and next (`lead`) row of the group: {new column: source column}.

    `order` holds plain ascending column names, which must identify a row within its group.
    """
    lag, lead = lag or {}, lead or {}
    ordering = F.struct(*order)
    aggs = []
    if lag:
        aggs.append(F.max_by(F.struct(*[F.col(s).alias(n) for n, s in lag.items()]), ordering).alias("_last"))
    if lead:
        aggs.append(F.min_by(F.struct(*[F.col(s).alias(n) for n, s in lead.items()]), ordering).alias("_first"))
    edges = df.groupBy(*keys, slice_col).agg(*aggs)
    ew = _w(keys, [slice_col])
    cols = [*keys, slice_col]
    if lag:
        edges = edges.withColumn("_prev", F.lag("_last").over(ew))
        cols.append("_prev")
    if lead:
        edges = edges.withColumn("_next", F.lead("_first").over(ew))
        cols.append("_next")
    lw = _w([*keys, slice_col], order)
    local = df
    if lag:
        local = local.withColumn(
            "_lag", F.lag(F.struct(*[F.col(s).alias(n) for n, s in lag.items()])).over(lw)
        )
    if lead:
        local = local.withColumn(
            "_lead", F.lead(F.struct(*[F.col(s).alias(n) for n, s in lead.items()])).over(lw)
        )
    joined = local.join(edges.select(*cols), [*keys, slice_col])
    out = [*df.columns]
    # a null local struct means "first/last row of its slice": take the neighbouring slice's edge
    for n in lag:
        out.append(F.coalesce(F.col("_lag"), F.col("_prev"))[n].alias(n))
    for n in lead:
        out.append(F.coalesce(F.col("_lead"), F.col("_next"))[n].alias(n))
    return joined.select(*out)


def carry_start(df: DataFrame, keys: list[str], slice_col: str, order: list[str], starts: Column, value: str, out: str) -> DataFrame:
    """`value` of the latest row at or before each row for which `starts` holds (island labels)."""
    flagged = df.withColumn("_m", F.when(starts, F.col(value)))
    last = flagged.groupBy(*keys, slice_col).agg(
        F.max_by("_m", F.when(F.col("_m").isNotNull(), F.struct(*order))).alias("_lm")
    )
    ew = _w(keys, [slice_col]).rowsBetween(W.unboundedPreceding, -1)
    last = last.select(*keys, slice_col, F.last("_lm", ignorenulls=True).over(ew).alias("_carry"))
    lw = _w([*keys, slice_col], order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = flagged.withColumn("_cur", F.last("_m", ignorenulls=True).over(lw))
    joined = local.join(last, [*keys, slice_col])
    return joined.select(*df.columns, F.coalesce("_cur", "_carry").alias(out))


def by_group_size(df: DataFrame, keys: list[str], limit: int, small, large) -> DataFrame:
    """Apply `small` to groups of up to `limit` rows and `large` to the others.

    A map-side combined count finds the large groups first. Usually there are none and `small` runs
    on the input as it is; otherwise the rows of the large groups are written out once, because
    `large` reads them several times.
    """
    counts = df.groupBy(*keys).agg(F.count("*").alias("_size"))
    big = materialize(counts.filter(F.col("_size") > limit).select(*keys), "large-groups")
    if big.isEmpty():
        return small(df)
    rest = small(df.join(big, keys, "left_anti"))
    return rest.unionByName(large(materialize(df.join(big, keys, "left_semi"), "large-group-rows")))
