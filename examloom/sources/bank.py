"""Item bank and taxonomy documents: readers, writers, label carry-over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas


def read_bank(spark: SparkSession, path: str) -> DataFrame:
    """Items of multi-line JSON bank documents, with their file position."""
    doc = spark.read.schema(schemas.BANK).option("multiLine", True).json(path)
    return doc.select(F.posexplode("questions").alias("bank_pos", "q")).select(
        "q.*", F.col("bank_pos").cast("bigint").alias("bank_pos")
    )


def read_exam_years(spark: SparkSession, path: str) -> DataFrame:
    doc = spark.read.schema(schemas.BANK).option("multiLine", True).json(path)
    return doc.select(F.explode("years").alias("year")).distinct()


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    doc = spark.read.schema(schemas.TAXONOMY).option("multiLine", True).json(path)
    return doc.select(F.explode("topics").alias("t")).select("t.*")


def write_bank(questions: DataFrame, path: str) -> None:
    """Tagged items as JSON lines, one folder per exam year."""
    questions.repartition("year", F.pmod(F.xxhash64("id"), F.lit(8))).write.mode("overwrite").partitionBy("year").json(path)


def write_taxonomy(topics: DataFrame, path: str) -> None:
    topics.select("slug", "label", "area").write.mode("overwrite").json(path)


def write_dump(classified: DataFrame, path: str) -> None:
    """Per-year dump of text, source, topics and scores (scores as an ordered array)."""
    classified.write.mode("overwrite").partitionBy("year").json(path)


def carry_over(items: DataFrame, previous: DataFrame, key: str = "id") -> DataFrame:
    """Topics of an earlier run (non-empty ones only), an empty array where there are none."""
    prev = previous.filter(F.size("topics") > 0).select(key, F.col("topics").alias("_t"))
    out = items.drop("topics").join(prev, key, "left")
    return out.withColumn("topics", F.coalesce("_t", F.array().cast("array<string>"))).drop("_t")


def restrict_years(items: DataFrame, years: list[int]) -> DataFrame:
    """Items of the requested exam years (a partition filter on tables laid out by year)."""
    return items.filter(F.col("year").isin(years))


def missing_years(requested: DataFrame, configured: DataFrame) -> DataFrame:
    return requested.select("year").distinct().join(configured.select("year"), "year", "left_anti")
