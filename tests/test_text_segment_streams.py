"""Text folding and classification, segmentation, answer keys, streams."""

import re
import unicodedata

from pyspark.sql import functions as F

from examloom.functions import text as tx
from examloom.operators import answerkey as Q
from examloom.operators import classify as C
from examloom.operators import segment as O
from examloom.plans import load

SF = "/root/testdata/sf0.001"


def plain_normalize(t):
    for a, b in tx.LIGATURES.items():
        t = t.replace(a, b)
    t = t.translate({ord(c): None for c in tx.STRAY_MARKS})
    t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower()
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9()*+\-\\/.,;:_\s]", " ", t))


def test_normalize_equals_decomposition(spark):
    samples = ["fun¸c˜ao gr´afico", "ﬁm da œuvre æther ﬃ", "ÀÉÎõü ß Æ Œ", "½ № ⑩ … ĳ Ǆ ™", "é combining", "İstanbul K Å",
               "`back`tick", "한국어 日本 ｆｕｌｌ", "  tabs\tand\nlines  ", "a* c++ \\ / .,;:_", "", "𝐀𝟘 ﷺ ㎏"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i INT, t STRING")
    got = {r.i: r.n for r in df.select("i", tx.normalize("t").alias("n")).collect()}
    assert got == {i: plain_normalize(s) for i, s in enumerate(samples)}


def test_classification_cutoffs(spark):
    rules = [("a", r"\balpha\b", 3), ("a", "beta", 1), ("b", "gamma", 3), ("c", "delta", 1), ("d", "gam+a", 3), ("e", "gamma", 3)]
    docs = spark.createDataFrame([(1, "alpha alpha alpha alpha"), (2, "delta"), (3, "alpha gamma"), (4, "")], "doc_id INT, text STRING")
    got = {r.doc_id: (r.topics, [(s.slug, s.score) for s in r.scores]) for r in C.classify(docs, rules).collect()}
    assert got[1] == (["a"], [("a", 9)])  # three hits at most
    assert got[2] == ([], [("c", 1)])  # weak evidence alone is not reported
    assert got[3] == (["a", "b", "d"], [("a", 3), ("b", 3), ("d", 3), ("e", 3)])  # three topics at most, ties by name
    assert got[4] == ([], [])


def test_literal_shortcut_equals_regex(spark):
    docs = spark.createDataFrame([("aaaa lorem ipsum lorem",), ("x",)], "n STRING")
    for p in ["aa", "lorem", r"\blorem\b", r"lor.m i", "(?:ipsum|x)", r"ab?a"]:
        got = [r.h for r in docs.select(tx.hits(F.col("n"), p).alias("h")).collect()]
        assert got == [len(re.findall(p, r.n)) for r in docs.collect()], p


def test_quality_gate(spark):
    good = "considere a alternativa correta para que seja " * 3
    rows = [(1, "short"), (2, good), (3, "\x01\x02\x03 \x04" * 40), (4, "zzz yyy xxx " * 30), (5, " " * 80)]
    df = spark.createDataFrame(rows, "i INT, text STRING")
    assert {r.i: r.usable for r in C.usable(df, "text").collect()} == {1: False, 2: True, 3: False, 4: False, 5: False}


def words(spark, rows):
    return spark.createDataFrame(
        [(1, p, i, t, x, y, x + 5, y + 10) for i, (p, t, x, y) in enumerate(rows)],
        "doc_id BIGINT, page INT, word_no INT, text STRING, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE")


def test_anchor_chain_uses_last_kept(spark):
    a = spark.createDataFrame(
        [(1, "dot", 8.0, 0, i, y, 0, 7, 50.0, y + 1) for i, y in enumerate([10.0, 12.0, 14.0, 16.0])],
        "doc_id BIGINT, pattern STRING, tol DOUBLE, page INT, word_no INT, y0 DOUBLE, prank INT, number BIGINT, x0 DOUBLE, y1 DOUBLE")
    # 12 repeats 10; 14 is more than 3 from the kept 10; 16 repeats 14
    assert sorted(r.y0 for r in O.dedupe_near(a).collect()) == [10.0, 14.0]


def test_segments_cover_pages(spark):
    rows = []
    for n in range(1, 17):
        page = 0 if n <= 8 else 1 if n <= 15 else 3
        y = 50.0 + 40 * ((n - 1) % 8)
        rows += [(page, f"{n}.", 50.0, y), (page, f"word{n}", 90.0, y + 1)]
    rows += [(2, "between", 90.0, 60.0), (4, "after", 90.0, 60.0), (3, "12.", 300.0, 700.0)]
    w = words(spark, rows)
    anchors = O.find_anchors(w)
    assert [r.number for r in anchors.orderBy("page", "y0").collect()] == list(range(1, 17))
    text = {r.number: r.text for r in O.segment_text(w, anchors).collect()}
    assert text[3] == "3. word3"
    # whole pages in between belong to the open item; nothing after the last item's page does
    assert text[15] == "15. word15 between"
    assert text[16] == "16. word16 12."


def test_answer_keys(spark):
    keys = spark.createDataFrame(
        [(1, "1. (A)\n2 - *\n3. ANULADA\n3. (B)\n4 ∗"), (2, "1 2 3 4 5\nA b * D E\nrest"), (3, "o1 - D 02 - e 03 - *")], "doc_id BIGINT, text STRING")
    keys = keys.withColumn("text", Q.repair("text"))
    expected = spark.createDataFrame([(d, n) for d in (1, 2, 3) for n in range(1, 6)], "doc_id BIGINT, number BIGINT")
    got = {}
    for r in Q.parse_best(keys, expected).collect():
        got.setdefault(r.doc_id, {})[r.number] = r.answer if not r.annulled else "annulled"
    # the look-alike asterisk is read as annulled too
    assert got == {1: {1: "A", 2: "annulled", 3: "annulled", 4: "annulled"},
                   2: {1: "A", 2: "B", 3: "annulled", 4: "D", 5: "E"}, 3: {1: "D", 2: "E", 3: "annulled"}}


def test_streams_equal_batch_and_replay_is_safe(spark, rows, tmp_path):
    from examloom.sources import adapters as A
    from examloom.streaming import jobs

    reg = load()
    keys = ["user_id", "item"]
    stream = reg["stream_sm2"].plan(spark, SF)
    batch = reg["sm2_fold"].plan(spark, SF)
    assert rows(stream.select(*sorted(batch.columns)), *keys) == rows(batch.select(*sorted(batch.columns)), *keys)

    folder = str(tmp_path / "log")
    e = A.events(spark, SF).select("user_id", "item", "value", "ts_us")
    for batch_id, part in enumerate([e.filter("ts_us % 3 = 0"), e.filter("ts_us % 3 <> 0"), e.filter("ts_us % 3 = 0")]):
        from examloom.operators import merge as M

        M.lww(part.withColumn("device_rank", F.lit(0)), keys, F.col("ts_us")).write.parquet(f"{folder}/batch={batch_id}")
    merged = jobs.latest_versions(spark, folder, keys, "ts_us")
    want = e.groupBy(*keys).agg(F.max("ts_us").alias("ts_us"))
    assert rows(merged.select(*keys, "ts_us"), *keys) == rows(want, *keys)
    jobs.compact(spark, folder, str(tmp_path / "table"), keys, "ts_us")
    assert spark.read.parquet(str(tmp_path / "table")).count() == want.count()
