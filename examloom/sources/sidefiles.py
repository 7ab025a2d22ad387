"""Per-session scratch files `{root}/{user}/{session}.json`, one JSON map of item -> scratch each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import core as fx
from . import schemas


def read_scratch(spark: SparkSession, root: str) -> DataFrame:
    """Scratch rows keyed by the file path; unreadable files count as empty."""
    files = spark.read.option("wholetext", True).text(f"{root}/*/*.json").withColumn("_p", F.col("_metadata.file_path"))
    parts = F.split("_p", "/")
    rows = files.select(
        F.element_at(parts, -2).alias("user_id"),
        F.regexp_replace(F.element_at(parts, -1), r"\.json$", "").alias("session_id"),
        F.explode(F.from_json("value", schemas.SCRATCH)).alias("question_id", "v"),
    )
    return keep_content(rows.select("user_id", "session_id", "question_id", "v.text", "v.drawing"))


def keep_content(scratch: DataFrame) -> DataFrame:
    """Drop blank entries; a session with none left has no file."""
    return scratch.filter(fx.has_content(F.coalesce("text", F.lit("")), F.coalesce("drawing", F.lit(""))))


def scratch_maps(scratch: DataFrame) -> DataFrame:
    """One JSON document per session, as stored."""
    entry = F.struct("question_id", F.struct("text", "drawing"))
    maps = keep_content(scratch).groupBy("user_id", "session_id").agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
    return maps.select("user_id", "session_id", F.to_json("m").alias("data"))


def write_scratch(scratch: DataFrame, root: str) -> None:
    """Documents partitioned by user, so that one user's files can be dropped as one folder."""
    scratch_maps(scratch).repartition("user_id", "session_id").write.mode("overwrite").partitionBy("user_id").json(root)


def fetch(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Remote scratch only where a session has no local scratch at all."""
    keys = ["user_id", "session_id"]
    mine = keep_content(local)
    have = mine.select(*keys).distinct()
    return mine.withColumn("origin", F.lit("local")).unionByName(
        keep_content(remote).join(have, keys, "left_anti").withColumn("origin", F.lit("remote"))
    )


def drop_sessions(scratch: DataFrame, doomed: DataFrame) -> DataFrame:
    return scratch.join(doomed.select("user_id", "session_id").distinct(), ["user_id", "session_id"], "left_anti")
