"""Mixing sources to target weights by pivotal rounding.

A source's target is its share by weight of the budget, limited to `cap` times its size; what the limit frees is
shared again by weight. A row of a source with target t and size S is wanted t/S times: the whole part is fixed, the
fraction is a copy probability. Two rows of a source are paired at a time and mass is moved between them, in either
direction at random with the odds that keep both expectations, until one is 0 or 1. Mass counts words, so a source's
taken words change by nothing but the rounding of its very last row. Rows are paired inside small buckets, each of
which leaves one fractional row; these are paired again, `fan_in` buckets at a time, up a tree until each source has
one left, which a last draw rounds.

Draws and orders come from hashes of the row's columns and the seed: reruns agree, and so does a repeated task. Rows that
are equal in all these columns are told apart by their number among themselves. So many rows of one id spread over the
buckets like any others, and as equal rows can stand for each other, it makes no difference which gets which number.

Defined cases: null text has size 0; rows of size 0 are rounded on their own; a source whose size is 0 has target 0
and no copies; null is a source of its own and sorts last; repeated rows are separate rows; an empty table stays empty.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, scratch
from .common import KEY, aside, keyed, numbered, small

SALTS = 64


def words(text: Column) -> Column:
    """Number of words; a word is a run of characters other than blanks, tabs and line ends."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_key(c: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~"))


def targets(rows: DataFrame, weights: list[float], budget: float, cap: float) -> DataFrame:
    """Per source key: n, source_size, target. The table may hold any number of sources.

    Weights repeat over the sources in code point order, null last. Sharing again by weight until no target is above
    its limit is one level `lam` with target = min(lam * weight, limit); each turn of the loop is one aggregate and
    sends two sums to the driver.
    """
    stats = rows.groupBy("_src").agg(
        F.min("source").alias("_name"), F.count("*").alias("_n"), F.sum("size").alias("source_size")
    )
    stats = numbered(stats.orderBy(F.col("_name").isNull(), "_name"), [], "sources", "_rank")
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("_rank") % len(weights) + 1).cast("int"))
    stats = materialize(
        stats.select("_src", "_n", "source_size", weight.alias("_w"), (F.col("source_size") * cap).alias("_cap")), "weights"
    )
    whole = stats.agg(F.sum("source_size"), F.sum("_w")).first()
    total, lam, full = (whole[0] or 0) * budget, 0.0, -1
    if whole[1]:
        lam = total / whole[1]
        while True:
            over = F.col("_cap") < lam * F.col("_w")
            x = stats.agg(
                F.count(F.when(over, 1)), F.sum(F.when(over, F.col("_cap"))), F.sum(F.when(~over, F.col("_w")))
            ).first()
            if x[0] == full or not x[2]:
                break
            full, lam = x[0], (total - (x[1] or 0.0)) / x[2]
    return stats.withColumn("target", F.least(F.col("_w") * lam, F.col("_cap").cast("double")))


def pivotal(p: np.ndarray, size: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Pair the rows in order until at most one is fractional. Returns probabilities, all 0 or 1 but for one.

    The survivor of a pair meets the next row. `draw` is a number in [0, 1) for each row.
    """
    p = p.astype(float).copy()
    left = -1
    for k in range(len(p)):
        if not 0.0 < p[k] < 1.0:
            continue
        if left < 0:
            left = k
            continue
        a, b = left, k
        up = min(size[a] * (1 - p[a]), size[b] * p[b])  # words that may move from b to a
        down = min(size[a] * p[a], size[b] * (1 - p[b]))
        if draw[k] * (up + down) < down:
            a_full, moved = size[a] * (1 - p[a]) <= size[b] * p[b], up
            b_end, a_end = 0.0, 1.0
        else:
            a_full, moved = size[a] * p[a] <= size[b] * (1 - p[b]), -down
            b_end, a_end = 1.0, 0.0
        if a_full:
            p[a], p[b], left = a_end, min(max(p[b] - moved / size[b], 0.0), 1.0), b
        else:
            p[a], p[b], left = min(max(p[a] + moved / size[a], 0.0), 1.0), b_end, a
        if not 0.0 < p[left] < 1.0:
            left = -1
    return p


def mix(
    df: DataFrame,
    source: str,
    size: Column,
    order: list[str],
    same: list[str] = (),
    keep: list[str] = (),
    weights=(5, 2, 1),
    budget: float = 1.5,
    cap: float = 2.0,
    seed: int = 1,
    bucket_rows: int = 1024,
    fan_in: int = 256,
) -> DataFrame:
    """Per row of `df`: its row key, the columns `keep`, size, source_size, target and copies.

    `df` must be the result of `keyed`. `order` names the columns whose hash orders rows and drives the draws, `same` all
    others in which rows of one key may differ.
    """
    with scratch(df.sparkSession) as stay:
        options = (list(weights), budget, cap, seed, bucket_rows, fan_in)
        return stay(_mix(df, source, size, [*order, *same], [*KEY, *keep], *options), "mixed")


def _mix(
    df: DataFrame, source: str, size: Column, order: list[str], keep: list[str], weights: list[float], budget: float,
    cap: float, seed: int, bucket_rows: int, fan_in: int,
) -> DataFrame:
    rows = df.select(
        *keep,
        F.col(source).cast("string").alias("source"),
        size.alias("size"),
        F.xxhash64(F.lit(seed), *order).alias("_h"),
    ).withColumn("_src", source_key("source"))
    rows = told_apart(materialize(rows, "mix-rows"))
    want = targets(rows, weights, budget, cap)
    # one source may hold most rows: its rows meet its target under many keys
    salted = want.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_salt", F.pmod("_h", F.lit(SALTS)).cast("int")).join(salted, ["_src", "_salt"])
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(0.0)
    rows = rows.withColumn("_whole", F.floor(ratio).cast("int")).withColumn("_p", ratio - F.floor(ratio))
    buckets = F.greatest(F.ceil(F.col("_n") / bucket_rows), F.lit(1))
    rows = rows.withColumn("_bucket", F.pmod(F.shiftright("_h", 8), buckets).cast("long"))
    rows = rows.select(*keep, "_src", "size", "source_size", "target", "_h", "_whole", "_p", "_bucket")
    schema = rows.schema.simpleString()[7:-1]

    def level(turn: int):
        def settle(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["_h", "size", *KEY], kind="stable").reset_index(drop=True)
            draw = draws(pdf["_h"].to_numpy(), seed, turn)
            p, s = pdf["_p"].to_numpy(float), pdf["size"].to_numpy(float)
            empty = s <= 0
            out = np.where(empty, (draw < p).astype(float), p)
            out[~empty] = pivotal(p[~empty], s[~empty], draw[~empty])
            pdf["_p"] = out
            return pdf

        return settle

    top = want.agg(F.max("_n")).first()[0] or 0
    width, turn, done = max(1, math.ceil(top / bucket_rows)), 0, None
    now = rows
    while True:
        now = now.groupBy("_src", "_bucket").applyInPandas(level(turn), schema)
        now = materialize(now, "mix-level")
        settled = now.where("_p in (0, 1)")
        done = settled if done is None else done.unionByName(settled)
        now = now.where("_p not in (0, 1)")
        if width == 1:
            break
        width, turn = math.ceil(width / fan_in), turn + 1
        now = now.withColumn("_bucket", F.floor(F.col("_bucket") / fan_in).cast("long"))
    last = (F.pmod(F.xxhash64(F.lit(seed), F.lit("last"), "_h"), F.lit(1 << 30)) / float(1 << 30)) < F.col("_p")
    done = done.unionByName(now.withColumn("_p", F.when(last, 1.0).otherwise(0.0)))
    return done.select(
        *keep, "size", "source_size", "target", (F.col("_whole") + F.col("_p").cast("int")).alias("copies")
    )


def told_apart(rows: DataFrame) -> DataFrame:
    """Rows that share a hash get further ones from their number among themselves."""
    twins = rows.groupBy("_h").agg(F.count("*").alias("_c")).where("_c > 1").select("_h")
    twins = materialize(twins, "mix-twins")
    if twins.isEmpty():
        return rows
    twins = small(twins)
    again = numbered(rows.join(twins, "_h", "left_semi"), ["_h"], "mix-twins", "_nth")
    again = again.withColumn("_h", F.xxhash64("_h", "_nth")).drop("_nth")
    return materialize(rows.join(twins, "_h", "left_anti").unionByName(again), "mix-rows")


def draws(h: np.ndarray, seed: int, turn: int) -> np.ndarray:
    """A number in [0, 1) for each hash, other ones at each level of the tree."""
    x = h.astype(np.int64).view(np.uint64) + np.uint64((seed * 1_000_003 + turn + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53)


def mixed(df: DataFrame, source: str, size: Column, order: list[str], **options) -> DataFrame:
    """The mix itself: every row as often as it is taken, with the columns of `df`.

    `size` may read any column whose name does not begin with an underscore.
    """
    plain, names, back = aside(df)
    rows = keyed(plain, "mix-input")
    same = [names[c] for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    taken = mix(rows, names[source], size, [names[c] for c in order], same, **options).where("copies > 0")
    taken = taken.select(*KEY, F.col("copies").alias("_copies"))
    out = rows.join(taken, KEY).withColumn("_copies", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return back(out)


def report(df: DataFrame, keys: list[str], source: str, text: str, **options) -> DataFrame:
    """Per row: keys, size, source_size, target and the words taken."""
    rows = keyed(df.select(*keys, source, text), "mix-input")
    got = mix(rows, source, words(F.col(text)), keys, [source, text], keys, **options)
    return got.select(
        *keys, "size", F.col("source_size").cast("long"), "target", (F.col("size") * F.col("copies")).alias("taken")
    )
