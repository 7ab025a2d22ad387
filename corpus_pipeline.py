"""The corpus pipeline: from raw documents to sharded training data.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. It works on all that its predecessor kept, and its result
is written as Parquet and read again as the next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from examloom.llm import decontam, mixing, ngramjoin, quality, sharding
from examloom.session import materialize

N_SHARDS = 40


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the classifier rejects (score below 0.5). It learns from all labels of the documents given."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, "doc_id", "text", labels, "quality", F.lit(True))
    return quality.accepted(docs, "text", model, least=0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by a Jaccard similarity of 0.8 or more on five-word shingles."""
    return ngramjoin.distinct(docs, "doc_id", "text", k=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop every document that holds ten consecutive words of a benchmark item, or a whole shorter item."""
    return decontam.clean(docs, "text", spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that the sources' words meet their target weights."""
    return mixing.mixed(docs, "source", mixing.words(F.col("text")), ["doc_id"])


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add the shard of each document; copies of one document share a shard."""
    return sharding.assign(docs, ["doc_id"], sharding.even(N_SHARDS))


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("mixing sources to target weights", mix_sources),
    ("sharding", shard),
]

#: SQL can express neither the classifier nor the random mix; tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
