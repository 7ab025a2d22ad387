"""Answer keys: three text layouts, the best of them per document, and reconciliation with the items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import core as fx

# Layouts of an answer key. (?d): only \n ends a line.
LINE = r"(?imd)^\s*(\d{1,2})[.\s\-]+\(?(?:QUEST[ÃA]O\s+)?([A-E]\b|[*∗]|ANULADA\b|NULA\b)\)?"
INLINE = r"(?i)\b0*(\d{1,2})\s*-\s*([A-E]\b|[*∗])"
ANNULLED = ["*", "∗", "ANULADA", "NULA"]
MIN_PAIRS = 5
METHODS = ["lines", "pairs", "inline"]  # in order of preference on ties


def repair(text) -> Column:
    """A leading letter o read for a zero."""
    return F.regexp_replace(fx.col(text), r"(?i)\bo(\d)", "0$1")


def _answers(rows: DataFrame) -> DataFrame:
    """First entry per (doc, number), as answer or annulled."""
    raw = F.upper("raw")
    first = rows.groupBy("doc_id", "number").agg(F.min_by("raw", "at").alias("raw"))
    gone = raw.isin(ANNULLED)
    return first.select("doc_id", "number", F.when(~gone, raw).alias("answer"), gone.alias("annulled"))


def _matches(keys: DataFrame, pattern: str) -> DataFrame:
    p = F.lit(pattern)
    pairs = F.arrays_zip(
        F.regexp_extract_all("text", p, F.lit(1)).alias("number"), F.regexp_extract_all("text", p, F.lit(2)).alias("raw")
    )
    rows = keys.select("doc_id", F.posexplode_outer(pairs).alias("at", "_m")).filter("_m is not null")
    return rows.select("doc_id", "at", F.col("_m.number").cast("bigint").alias("number"), F.col("_m.raw").alias("raw"))


def parse_lines(keys: DataFrame) -> DataFrame:
    return _answers(_matches(keys, LINE))


def parse_inline(keys: DataFrame) -> DataFrame:
    return _answers(_matches(keys, INLINE))


def parse_pairs(keys: DataFrame) -> DataFrame:
    """A line of numbers with a line of as many answers below it (five or more)."""
    blank = r"\s+"

    def cells(line):
        return F.filter(F.split(line, blank), lambda t: t != "")

    lines = F.transform(F.split("text", "\n"), cells)

    def pair(i):
        nums, ans = F.get("_l", i), F.get("_l", i + 1)
        good = (
            (F.size(nums) >= MIN_PAIRS)
            & (F.size(nums) == F.size(ans))
            & F.forall(nums, lambda t: F.rlike(t, F.lit(r"^\d{1,2}$")))
            & F.forall(ans, lambda t: F.rlike(t, F.lit(r"^[A-Ea-e*∗]$")))
        )
        zipped = F.zip_with(nums, ans, lambda n, a: F.struct(n.alias("number"), a.alias("raw")))
        return F.when(good, zipped).otherwise(F.slice(zipped, 1, 0))

    k = keys.select("doc_id", lines.alias("_l")).filter(F.size("_l") > 1)
    found = F.flatten(F.transform(F.sequence(F.lit(0), F.size("_l") - 2), pair))
    rows = k.select("doc_id", F.posexplode_outer(found).alias("at", "_m")).filter("_m is not null")
    return _answers(
        rows.select("doc_id", "at", F.col("_m.number").cast("bigint").alias("number"), F.col("_m.raw").alias("raw"))
    )


def parse_best(keys: DataFrame, expected: DataFrame) -> DataFrame:
    """Per document the layout that covers most expected numbers (doc_id, number); first layout on ties."""
    parsed = None
    for i, (name, fn) in enumerate(zip(METHODS, (parse_lines, parse_pairs, parse_inline))):
        part = fn(keys).withColumn("method", F.lit(name)).withColumn("_i", F.lit(-i))
        parsed = part if parsed is None else parsed.unionByName(part)
    hit = expected.select("doc_id", "number", F.lit(1).alias("_hit")).distinct()
    score = (
        parsed.join(hit, ["doc_id", "number"], "left")
        .groupBy("doc_id", "method", "_i")
        .agg(F.count("_hit").alias("overlap"))
    )
    # layouts without any entry take part with overlap 0; only the first of them can win
    first = F.lit(METHODS[0]).alias("method")
    score = score.unionByName(score.select("doc_id", first, F.lit(0).alias("_i"), F.lit(0).cast("bigint").alias("overlap")).distinct())
    best = score.groupBy("doc_id").agg(F.max_by(F.struct("method", "overlap"), F.struct("overlap", "_i")).alias("_b"))
    best = best.select("doc_id", "_b.method", "_b.overlap")
    return parsed.drop("_i").join(best, ["doc_id", "method"])


def reconcile(items: DataFrame, key: DataFrame) -> DataFrame:
    """Items against key entries (doc_id, number): `ok`, `missing_answer` or `extra_answer`."""
    i = items.select("doc_id", "number", F.lit(True).alias("_i"))
    k = key.select("doc_id", "number", "answer", "annulled", F.lit(True).alias("_k"))
    j = i.join(k, ["doc_id", "number"], "full_outer")
    status = (
        F.when(F.col("_k").isNull(), F.lit("missing_answer"))
        .when(F.col("_i").isNull(), F.lit("extra_answer"))
        .otherwise(F.lit("ok"))
    )
    return j.select("doc_id", "number", status.alias("status"), "answer", F.coalesce("annulled", F.lit(False)).alias("annulled"))


def assemble_bank(items: DataFrame, key: DataFrame, previous: DataFrame) -> DataFrame:
    """Bank rows from items (year, number[, area]) with key entries and earlier topics, null/false/empty by default.

    An explicit section area beats the one derived from the item number.
    """
    k = key.select("year", "number", "answer", "annulled")
    prev = previous.filter(F.size("topics") > 0).select("id", F.col("topics").alias("_t"))
    area = fx.area_for("number", "year")
    if "area" in items.columns:
        area = F.coalesce("area", area)
    rows = items.withColumn("id", fx.item_id("year", "number")).withColumn("area", area)
    return (
        rows.join(k, ["year", "number"], "left")
        .join(prev, "id", "left")
        .select(
            "id", "year", "number", "area", fx.image_path("year", "number").alias("image"), "answer",
            F.coalesce("annulled", F.lit(False)).alias("annulled"),
            F.coalesce("_t", F.array().cast("array<string>")).alias("topics"),
        )
    )
