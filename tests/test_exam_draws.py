"""Random exams: permutations per request, exactness under exclusion, switches, labels."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from examloom.operators import permute
from examloom.operators import sampling as K

QUESTION = "question_id BIGINT, year INT, number INT, area STRING, annulled BOOLEAN, topics ARRAY<STRING>, bank_pos BIGINT"


def bank(spark, n, area="x", topics=lambda k: ["t"], annulled=lambda k: False):
    return spark.createDataFrame([(k, 2000, k, area, annulled(k), topics(k), k) for k in range(n)], QUESTION)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 20, 401])
def test_every_request_meets_every_place_once(spark, n):
    df = permute.with_keys(spark.range(200).select(F.col("id").alias("u"), F.lit(n).alias("n")), "n", "s", "u")
    df = df.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_steps") - 1)))
    got = Counter((r.u, r.p) for r in permute.place(df, "i", "p").select("u", "p").collect() if r.p < n)
    assert got == Counter((u, p) for u in range(200) for p in range(n))
    assert df.filter("u = 0").count() < n + math.isqrt(n) + 1


def test_draws_are_independent_and_even(spark):
    users = spark.range(2000).select(F.col("id").alias("user_id"))
    got = K.random_exam(users, bank(spark, 400), None, "s", {"x": 20}, exclude_correct=False)
    rows = got.groupBy("user_id").agg(F.sort_array(F.collect_list("question_id")).alias("q")).collect()
    assert all(len(set(r.q)) == 20 for r in rows)
    assert len({tuple(r.q) for r in rows}) > 1990
    n = Counter(q for r in rows for q in r.q)
    chi = sum((n[q] - 100) ** 2 / 100 for q in range(400)) / (1 - 20 / 400)
    assert abs(chi - 399) < 5 * math.sqrt(2 * 399)
    pairs = Counter((a // 20, b // 20) for r in rows for a in r.q for b in r.q if a < b)
    assert max(pairs.values()) < 2.6 * 2000 * 190 / 400  # no block of items comes with another


def test_steps_stay_in_proportion_to_what_is_served(spark):
    items = K.ring(bank(spark, 1000).select("question_id", "area"), ["area"], "s")
    requests = spark.range(300).select(F.col("id").alias("user_id"), F.lit("x").alias("area"), F.lit(20).cast("bigint").alias("need"))
    seen = spark.sparkContext.accumulator(0)
    passes = []

    def accept(rows):
        passes.append(rows.count())
        seen.add(passes[-1])
        return rows.filter("question_id % 2 = 0")  # half of the bank is refused

    got = K.draw(requests.withColumn("skip", F.lit(500)), items, ["area"], "s", accept)
    assert got.count() == 300 * 20
    assert sum(passes) <= 3 * 300 * 20
    # and nothing known in advance, almost all refused: exact after further passes
    got = K.draw(requests, items, ["area"], "s", lambda rows: rows.filter("question_id % 100 = 0"))
    assert [r[0] for r in got.groupBy("user_id").count().select("count").distinct().collect()] == [10]


def test_switches_and_labels(spark):
    users = spark.createDataFrame([(1,), (2,)], "user_id BIGINT")
    q = bank(spark, 10, annulled=lambda k: k == 0)
    attempts = spark.createDataFrame([(1, 1, True), (1, 2, False)], "user_id BIGINT, question_id BIGINT, correct BOOLEAN")
    ids = lambda df, u: {r.question_id for r in df.collect() if r.user_id == u}
    got = K.area_exam(users, q, attempts, ["x"], 20, "s")
    assert ids(got, 1) == set(range(2, 10)) and ids(got, 2) == set(range(1, 10))
    assert {(r.user_id, r.label) for r in got.collect()} == {(1, "Pratica: x (8q)"), (2, "Pratica: x (9q)")}
    open_ = K.area_exam(users, q, attempts, ["x"], 20, "s", exclude_annulled=False, exclude_correct=False)
    assert ids(open_, 1) == set(range(10))
    assert K.area_exam(users, q.limit(0), attempts, ["x"], 20, "s").count() == 0

    q = bank(spark, 12, topics=lambda k: [["a"], ["b"], ["a", "b"]][k % 3])
    sel = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b")], "user_id BIGINT, slug STRING")
    names = spark.createDataFrame([("a", "Alpha"), ("b", "Beta")], "slug STRING, label STRING")
    got = K.topic_exam(sel, q, 20, "s", topics=names).collect()
    assert {(r.question_id, r.slug) for r in got if r.user_id == 1} == {(k, "b" if k % 3 == 1 else "a") for k in range(12)}
    assert {r.question_id for r in got if r.user_id == 2} == {k for k in range(12) if k % 3}
    assert {(r.user_id, r.label) for r in got} == {(1, "Intercalado: Alpha, Beta (12q)"), (2, "Topico: Beta (8q)")}


def test_review_ranks_the_whole_topic(spark):
    q = bank(spark, 60, topics=lambda k: ["g"] if k % 2 else ["h", "g"])
    due = spark.createDataFrame([(1, "g", 5), (1, "h", 4), (2, "g", 1)], "user_id BIGINT, slug STRING, due_at BIGINT")
    seen = spark.createDataFrame([(1, 1, 50), (1, 3, 40), (1, 0, 7)], "user_id BIGINT, question_id BIGINT, last_seen BIGINT")
    ranked = K.review_candidates(due.withColumn("group_pos", F.lit(1)), q, seen, "s").filter("user_id = 1 and slug = 'g'")
    rows = [r for r in ranked.orderBy("rank").collect()]
    assert [r.rank for r in rows] == list(range(1, 61))
    assert {r.question_id for r in rows[:28]} == set(range(5, 60, 2)) and [r.question_id for r in rows[28:30]] == [3, 1]
    assert rows[-1].question_id == 0 and all(r.unseen for r in rows[30:59])
    got = K.topic_review(due, q, seen, "s", limit=45).collect()
    assert Counter(r.user_id for r in got) == {1: 45, 2: 45}
    assert {(r.user_id, r.label) for r in got} == {(1, "Revisao: h e g (45q)"), (2, "Revisao: g (45q)")}
    few = K.topic_review(due, q, seen, "s", limit=45, dedupe=True).filter("user_id = 1").collect()
    assert len({r.question_id for r in few}) == len(few) == 45


def test_nothing_refused_draws_only_what_is_served(spark, monkeypatch):
    """no step is unfolded for the places beyond the end, of which there are up to a row of digits."""
    monkeypatch.setattr(permute, "place", lambda *_: pytest.fail("steps unfolded as rows"))
    users = spark.range(50).select(F.col("id").alias("user_id"))
    for n in (3, 26, 401):
        got = K.area_exam(users, bank(spark, n), None, ["x"], 20, "s", exclude_annulled=False, exclude_correct=False).collect()
        assert Counter(r.user_id for r in got) == {u: min(n, 20) for u in range(50)}


def _asked(monkeypatch):
    asked, real = [], K.draw
    monkeypatch.setattr(K, "draw", lambda requests, *a, **k: asked.append(requests) or real(requests, *a, **k))
    return lambda: asked[-1].filter("need > 0").agg(F.sum("need")).scalar().alias("n")


def test_reviews_and_topic_exams_ask_for_their_share(spark, monkeypatch):
    """an exam over many topics draws about as many items as it serves, and still serves all it can."""
    asked = _asked(monkeypatch)
    q = bank(spark, 400, topics=lambda k: [f"t{k % 10}"])
    due = spark.createDataFrame([(u, f"t{t}", t) for u in (1, 2) for t in range(10)], "user_id BIGINT, slug STRING, due_at BIGINT")
    seen = spark.createDataFrame([(1, k, k) for k in range(0, 400, 10)], "user_id BIGINT, question_id BIGINT, last_seen BIGINT")
    got = K.topic_review(due, q, seen, "s").collect()
    assert Counter((r.user_id, r.slug) for r in got) == {(u, f"t{t}"): 2 for u in (1, 2) for t in range(10)}
    assert [r.question_id for r in sorted(got) if r.user_id == 1 and r.slug == "t0"] in ([0, 10], [10, 0])
    assert spark.range(1).select(asked()).first().n <= 40
    got = K.topic_exam(due.select("user_id", "slug"), q, 15, "s").collect()
    assert Counter(r.user_id for r in got) == {1: 15, 2: 15}
    assert spark.range(1).select(asked()).first().n == 40
    # most topics run out: the last one serves what is left
    q = bank(spark, 40, topics=lambda k: [f"t{k}" if k < 9 else "t9"])
    got = K.topic_exam(due.select("user_id", "slug"), q, 15, "s").collect()
    assert Counter(r.slug for r in got if r.user_id == 1) == {**{f"t{t}": 1 for t in range(9)}, "t9": 6}


def test_whole_review_lists_are_not_written(spark, monkeypatch):
    """the product of users and items is neither written nor sorted; ranks come from the permutation alone."""
    written, real = [], K.materialize
    monkeypatch.setattr(K, "materialize", lambda df, name: written.append(name) or real(df, name))
    q = bank(spark, 5000, topics=lambda k: ["g"])
    due = spark.range(5).select(F.col("id").alias("user_id"), F.lit("g").alias("slug"), F.lit(1).alias("group_pos"))
    seen = spark.createDataFrame([(1, 4, 9), (1, 8, 7), (1, 9999, 1)], "user_id BIGINT, question_id BIGINT, last_seen BIGINT")
    got = K.review_candidates(due, q, seen, "s")
    assert "drawn" not in written
    rows = got.groupBy("user_id").agg(F.count_distinct("rank").alias("n"), F.max("rank").alias("m"), F.count_distinct("question_id").alias("q"))
    assert sorted(map(tuple, rows.collect())) == [(u, 5000, 5000, 5000) for u in range(5)]
    tail = got.filter("user_id = 1 and not unseen").orderBy("rank").collect()
    assert [(r.rank, r.question_id) for r in tail] == [(4999, 8), (5000, 4)]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 20, 401])
def test_listed_rounds_meet_the_same_places(spark, n):
    df = permute.with_sums(permute.with_keys(spark.range(50).select(F.col("id").alias("u"), F.lit(n).alias("n")), "n", "s", "u"))
    df = df.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_steps") - 1)))
    df = permute.place(df, "i", "p").withColumn("_x", F.floor(F.col("i") / F.col("_b"))).withColumn("_y", F.col("i") % F.col("_b"))
    df = permute.place_by_sums(df, "q").withColumn("back", permute.steps_of(F.array("p"), permute.listed)[0])
    assert df.filter("p = q and back = i").count() == df.count() > 0


def test_whole_review_lists_are_not_joined_row_by_row(spark):
    """rows of the product meet no join and no shuffle, however large the bank is; requests meet whole lists of items."""
    q = bank(spark, 700, topics=lambda k: ["g"] if k % 3 else ["h", "g", "g"], annulled=lambda k: k % 50 == 0)
    due = spark.range(4).select(F.col("id").alias("user_id"), F.explode(F.array(F.lit("g"), F.lit("h"), F.lit("none"))).alias("slug"), F.lit(1).alias("group_pos"))
    seen = spark.createDataFrame([(1, k, 10000 - k) for k in range(0, 700, 7)] + [(2, k, k) for k in range(700)], "user_id BIGINT, question_id BIGINT, last_seen BIGINT")
    old = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = K.review_candidates(due, q, seen, "s")
        plan = got._jdf.queryExecution().executedPlan().toString().split("\n")
        above = plan[: next(k for k, line in enumerate(plan) if "Generate explode" in line)]
        assert not [line for line in above if "Join" in line or "Exchange" in line]
        rows = got.collect()
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    usable = [k for k in range(700) if k % 50]
    primary = {"g": [k for k in usable if k % 3], "h": [k for k in usable if k % 3 == 0]}
    second = {"g": 2 * primary["h"], "h": []}
    for u in range(4):
        for slug in ("g", "h"):
            mine = sorted((r for r in rows if r.user_id == u and r.slug == slug), key=lambda r: r["rank"])
            assert [r["rank"] for r in mine] == list(range(1, len(primary[slug]) + len(second[slug]) + 1))
            assert Counter(r.question_id for r in mine if not r.secondary) == Counter(primary[slug])
            assert Counter(r.question_id for r in mine if r.secondary) == Counter(second[slug])
            assert [(r.secondary, not r.unseen) for r in mine] == sorted((r.secondary, not r.unseen) for r in mine)
            met = {0: set(), 1: set(range(0, 700, 7)), 2: set(range(700)), 3: set()}[u]
            assert {r.question_id for r in mine if not r.unseen} == met & {*primary[slug], *second[slug]}
    assert not [r for r in rows if r.slug == "none"]
