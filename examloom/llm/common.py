"""Helpers shared by the training-data operators."""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Maps A-Z to a-z and every byte that is no digit, letter or part of a longer UTF-8 character to a blank.
ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

#: File hash and row number that `keyed` adds.
KEY = ["_file", "_row"]


def free(name: str, taken) -> str:
    """`name`, with underscores behind it as long as `taken` has it, in any case."""
    held = {c.lower() for c in taken}
    while name.lower() in held:
        name += "_"
    return name


def aside(df: DataFrame):
    """`df` with the columns that could clash with the operators' own renamed, which all begin with an underscore.

    Returns the table, its new names by the old ones, and a function that cuts a result down to the columns of `df`
    and gives them their names back.
    """
    names: dict[str, str] = {}
    for k, c in enumerate(df.columns):
        names[c] = free(f"kept{k}", [*df.columns, *names.values()]) if c.startswith("_") else c
    plain = df if list(names) == list(names.values()) else df.toDF(*names.values())
    return plain, names, lambda out: out.select(*names.values()).toDF(*names)


def keyed(df: DataFrame, name: str = "keyed") -> DataFrame:
    """Add a stable row key: two longs, the file's hash and the row's number in it.

    Rows read from Parquet carry their place already; any other input is written to the shared folder first.
    The key survives recomputation, unlike numbers taken from partition ids.
    """
    place = [F.xxhash64("_metadata.file_path").alias(KEY[0]), F.col("_metadata.row_index").alias(KEY[1])]
    try:
        return df.select(*df.columns, *place)
    except AnalysisException:
        stored = materialize(df, name)
        return stored.select(*stored.columns, *place)


def numbered(df: DataFrame, by: list[str], name: str, out: str, block: int = 65536) -> DataFrame:
    """Write `df` and number its rows per `by` from 0, without gaps, in stored order.

    Rows are numbered inside blocks of a file, so no task holds more than `block` rows of a group, whatever
    the skew; one running sum over the block counts gives each block its start.
    """
    stored = materialize(df, name)
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")
    chunk = F.coalesce(F.regexp_extract("_metadata.file_name", r"-c(\d+)\.", 1).try_cast("long"), F.lit(0))
    rows = stored.select(
        *stored.columns,
        (part * 1000 + chunk).alias("_f"),
        F.floor(F.col("_metadata.row_index") / block).alias("_b"),
        F.col("_metadata.row_index").alias("_r"),
    )
    place = [*by, "_f", "_b"]
    sums = W.partitionBy(*(by or [F.lit(0)])).orderBy("_f", "_b").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy(*place).agg(F.count("*").alias("_n"))
    starts = starts.select(*place, F.coalesce(F.sum("_n").over(sums), F.lit(0)).alias("_start"))
    inside = W.partitionBy(*place).orderBy("_r")
    rows = rows.withColumn("_at", F.row_number().over(inside) - 1)
    starts = starts.select(*[F.col(c).alias(f"_s_{c}") for c in place], "_start")
    on = None
    for c in place:
        x = F.col(c).eqNullSafe(F.col(f"_s_{c}")) if c in by else F.col(c) == F.col(f"_s_{c}")
        on = x if on is None else on & x
    return rows.join(starts, on).select(*stored.columns, (F.col("_start") + F.col("_at")).cast("long").alias(out))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def blobs(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """The column's texts as UTF-8 bytes."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def chunks(batches, column: str = "text", most: int = 2 << 20):
    """Cut record batches so that a piece holds about `most` bytes of text (one row at least).

    Pieces are cut by the texts' lengths alone and turned into Python bytes one at a time.
    """
    for batch in batches:
        upto = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(upto):
            held = upto[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(upto, held + most, side="right")))
            piece = batch.slice(start, stop - start)
            yield piece, blobs(piece, column)
            start = stop
        pa.default_memory_pool().release_unused()


def crc(value) -> int:
    return zlib.crc32(str(value).encode())


def remainder(doc_id: str | Column, m: int) -> Column:
    """crc32(doc_id as text) mod m; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % m


def share(spark, value):
    """Broadcast a value of bounded size together with the classes it needs."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shared(broadcast):
    return pickle.loads(broadcast.value)


def small(rows, most: int = 1_000_000):
    """A written table marked for broadcast if it has at most `most` (narrow) rows; else it is joined by a shuffle."""
    return F.broadcast(rows) if rows.count() <= most else rows
