"""Words and beginnings and ends of words are counted as plain text, with the counts of the regex."""

import re

from pyspark.sql import functions as F

from examloom.functions import text as tx
from examloom.operators import classify as C
from examloom.plans.rules import RULES


def test_bounded_literals_equal_the_regex(spark):
    texts = ["the the the", "the,the (the) other the_ _the the", "", None, "nation nationtion tion-tion", "THE Thé the\nthe", "a the", "xa xaa aa aaa a.a"]
    patterns = [r"\bthe\b", r"\bthe", r"the\b", r"tion\b", r"\btion", r"\ba\b", r"aa\b", r"\baa"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k INT, text STRING")
    d = C.normalized(df).withColumn("words", tx.spaced("norm"))
    rows = d.select("norm", *[tx.hits(F.col("norm"), p, F.col("words")).alias(f"h{k}") for k, p in enumerate(patterns)]).collect()
    for r in rows:
        assert [r[f"h{k}"] for k in range(len(patterns))] == [len(re.findall(p, r.norm or "")) for p in patterns], r.norm


def test_few_rules_need_the_regex_engine(spark):
    df = spark.createDataFrame([(1, "text")], "doc_id INT, text STRING")
    plan = C.scored(df, RULES)._jdf.queryExecution().optimizedPlan().toString()
    assert r"\bthat\b" not in plan and r"tion\b" not in plan and r"\bwww\." in plan
