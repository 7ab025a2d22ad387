"""Rendezvous sharding of stable keys over weighted shards.

Every row scores each shard by a hash of (key, shard), scaled by the shard's weight, and goes to the best one.
The choice depends on nothing but the key and the shards, so a lost task gives the same rows again, and a new
shard takes over only the rows on which it wins: about its share of the weight, and none move between old shards.

Defined cases: a null key is a key of its own; a null text has the size `overhead` and a null checksum; equal keys
share a shard; a weight of 0 or less gets no rows; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered

#: 13 hex digits of a digest: a whole number that a double holds exactly.
DIGITS = 13


def key_text(*keys: str) -> Column:
    """One text per key; nulls, separators and digits can't be mistaken for each other."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~"))
    return F.concat_ws("\x1f", *map(part, keys))


def cost(key: Column, shard: Column, weight: Column) -> Column:
    """-ln(u) / weight with u from the digest of key and shard; the least wins with a chance in proportion to weight."""
    digest = F.substring(F.md5(F.concat(key, F.lit("#"), shard.cast("string"))), 1, DIGITS)
    u = (F.conv(digest, 16, 10).cast("double") + 0.5) / float(16**DIGITS)
    return -F.log(u) / weight


def shard_of(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard with the least cost, the smaller number on a tie."""
    live = {int(k): float(w) for k, w in weights.items() if w > 0}
    if not live:
        raise ValueError("no shard has a weight above 0")
    shards = F.array(*(F.struct(F.lit(k).alias("id"), F.lit(w).alias("w")) for k, w in sorted(live.items())))
    costs = F.transform(shards, lambda s: F.struct(cost(key, s["id"], s["w"]).alias("cost"), s["id"].alias("id")))
    return F.array_min(costs)["id"].cast("int")


def assign(df: DataFrame, keys: list[str], weights: Mapping[int, float], out: str = "shard") -> DataFrame:
    """Add the shard of each row. Map-only."""
    return df.withColumn(out, shard_of(key_text(*keys), weights))


def even(n: int) -> dict[int, float]:
    return dict.fromkeys(range(n), 1.0)


def layout(df: DataFrame, keys: list[str], text: str, n_shards: int, overhead: int = 16) -> DataFrame:
    """Shards 0 to n-1 with sizes, checksums, the place inside the shard, and the shard with one more.

    Returns the keys, size, text_crc32, law, shard, slot and grown_shard. Only these narrow columns are shuffled.
    """
    utf8 = F.col(text).cast("binary")
    key = key_text(*keys)
    rows = df.select(
        *keys,
        (F.coalesce(F.octet_length(utf8), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(utf8).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(key, even(n_shards)).alias("shard"),
        key.alias("_key"),
    )
    new = F.struct(cost(F.col("_key"), F.lit(n_shards), F.lit(1.0)), F.lit(n_shards).alias("id"))
    old = F.struct(cost(F.col("_key"), F.col("shard"), F.lit(1.0)), F.col("shard").alias("id"))
    rows = rows.withColumn("grown_shard", F.least(old, new)["id"].cast("int")).drop("_key")
    return numbered(rows, ["shard"], "shards", "slot")
