"""Extra columns under the operators' own names, and one id for very many rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from examloom.llm import decontam, linededup, mixing, ngramjoin, quality
from examloom.llm.common import aside, free, keyed

EXTRA = ["_text", "_file", "_row", "_score", "_copies", "_kept", "_from", "_Items", "_h", "_root", "kept0"]
TEXTS = ["one two three four five six", "one two three four five six", None, "", "seven eight nine ten eleven\nseven eight nine ten eleven"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "a", *[f"{c}{k}" for c in EXTRA]) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in EXTRA))


def whole(rows, columns):
    """Every extra column still holds its own value."""
    assert rows.columns == columns
    got = rows.collect()
    assert all(r[c] == f"{c}{r.doc_id}" for r in got for c in EXTRA)
    return sorted(r.doc_id for r in got)


def test_names(docs):
    plain, names, back = aside(docs)
    assert not any(c.startswith("_") for c in plain.columns) and names["text"] == "text" and names["kept0"] == "kept0"
    assert len({c.lower() for c in plain.columns}) == len(docs.columns)
    assert back(plain).columns == docs.columns
    assert free("_a", ["_A", "_a_"]) == "_a__" and free("b", ["a"]) == "b"
    same = docs.select("doc_id", "text")
    assert aside(same)[0] is same


def test_clashing_columns(spark, docs, tmp_path):
    model = {"constant": 0.7}
    assert whole(quality.accepted(docs, "text", model), docs.columns) == [0, 1, 2, 3, 4]
    assert whole(quality.accepted(docs, "text", {"constant": 0.2}), docs.columns) == []
    assert whole(ngramjoin.distinct(docs, "doc_id", "text"), docs.columns) == [0, 2, 3, 4]
    bench = spark.createDataFrame([("b", "eight nine ten")], "item_id string, text string")
    assert whole(decontam.clean(docs, "text", bench), docs.columns) == [0, 1, 2, 3]
    # from a table as well, whose rows carry their place
    docs.write.parquet(str(tmp_path / "docs"))
    stored = spark.read.parquet(str(tmp_path / "docs"))
    for rows in (docs, stored):
        assert set(whole(mixing.mixed(rows, "source", mixing.words(F.col("text")), ["doc_id"]), docs.columns)) <= {0, 1, 2, 3, 4}
        lines = linededup.clean(rows, "doc_id", "text")
        assert whole(lines, docs.columns) == [0, 1, 2, 3, 4]
        assert sorted((r.doc_id, r.text) for r in lines.collect() if r.text) == [(0, TEXTS[0]), (4, "seven eight nine ten eleven")]


def test_a_text_column_of_a_clashing_name(docs):
    odd = docs.select("doc_id", "source", F.col("text").alias("_words"))
    assert sorted(r.doc_id for r in ngramjoin.distinct(odd, "doc_id", "_words").collect()) == [0, 2, 3, 4]
    assert quality.accepted(odd, "_words", {"constant": 0.7}).columns == odd.columns


def test_one_id_for_all_rows(spark):
    texts = [" ".join(["w"] * (1 + k % 7)) for k in range(600)]
    rows = spark.createDataFrame([(1, t, "a") for t in texts] + [(2, "x y z", "b")] * 900, "doc_id long, text string, source string")
    got = keyed(rows, "repeats")
    size = mixing.words(F.col("text"))
    runs = []
    for _ in range(2):
        mix = mixing.mix(got, "source", size, ["doc_id"], ["source", "text"], ["doc_id", "text"], bucket_rows=16, fan_in=4)
        runs.append(mix.collect())
    # equal rows can stand for each other: reruns agree on how often each different row is taken
    counts = [sorted((r.doc_id, r.text, r.copies) for r in run) for run in runs]
    assert counts[0] == counts[1] and len(counts[0]) == 1500
    for doc_id in (1, 2):
        part = [r for r in runs[0] if r.doc_id == doc_id]
        assert abs(sum(r.size * r.copies for r in part) - part[0].target) <= max(r.size for r in part)
    # draws are independent: the same text is taken more and less often
    assert len({r.copies for r in runs[0] if r.doc_id == 2}) == 2


def test_repeats_spread_over_buckets(spark):
    rows = spark.createDataFrame([(1, "x", "a")] * 2000, "doc_id long, text string, source string")
    hashed = keyed(rows, "repeats").select("_file", "_row", F.xxhash64("doc_id", "text").alias("_h"))
    got = [r._h for r in mixing.told_apart(hashed).collect()]
    assert len(set(got)) == 2000
    assert np.bincount(np.array(got) >> 8 & 15, minlength=16).max() < 250


def test_the_sample_is_bounded_by_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"text number {k} " * (k % 5 + 1)) for k in range(300)] + [(2, "a b c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append((len(x), len(y))) or {"constant": 0.5})
    for most in (1, 50):
        quality.train(docs, "doc_id", "text", labels, "quality", F.lit(True), most=most)
    assert seen[0] == (1, 1) and seen[1] == (50, 50)
