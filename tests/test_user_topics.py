"""Per-user topic tables against the full product of users and taxonomy."""

import random

import pytest
from pyspark.sql import functions as F

from examloom.operators import topicstats as T

TOPICS = [(f"t{k:02d}", f"Topic {k}", "ab"[k % 2]) for k in range(15)]


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(8)
    qs = [(k, 2000 + rng.randrange(9), "a", False, rng.sample([t[0] for t in TOPICS[:12]], rng.randrange(3))) for k in range(120)]
    latest = [(u, k, rng.choice(["A", "B", None]), rng.random() < 0.6) for u in range(1, 9) for k in range(120) if rng.random() < 0.04 * u]
    latest += [(9, k, "A", True) for k in range(120)]  # has touched all that occurs; user 0 nothing
    questions = spark.createDataFrame(qs, "question_id BIGINT, year INT, area STRING, annulled BOOLEAN, topics ARRAY<STRING>")
    topics = spark.createDataFrame(TOPICS, "slug STRING, label STRING, area STRING")
    latest = spark.createDataFrame(latest, "user_id BIGINT, question_id BIGINT, answer STRING, correct BOOLEAN")
    full = {}
    for u in range(10):
        rows = T.topic_stats(questions, topics, latest.filter(f"user_id = {u}")).collect()
        full[u] = [r.asDict() for r in rows]
    users = spark.range(10).select(F.col("id").alias("user_id"))
    return users, T.user_topic_stats(questions, topics, latest), T.default_stats(questions, topics), full


def order(key):
    column = {"priority": "priority", "incidence": "primary_count", "recent": "per_exam_recent", "trend": "trend", "accuracy": "accuracy"}[key]
    if key == "accuracy":
        return lambda r: (r[column] is None, r[column] or 0, r["slug"])
    return lambda r: (-r[column], r["slug"])


@pytest.mark.parametrize("key,n,area", [("priority", 3, None), ("accuracy", 4, None), ("trend", 15, None), ("recent", 2, "b"), ("incidence", 50, "a")])
def test_top_rows_equal_the_product(data, key, n, area):
    users, touched, defaults, full = data
    got = {}
    for r in T.user_top(users, touched, defaults, key, n, area).orderBy("user_id", "rank").collect():
        d = r.asDict()
        assert d.pop("rank") == len(got.setdefault(d.pop("user_id"), [])) + 1
        got[r.user_id].append(d)
    for u, rows in full.items():
        shown = sorted((r for r in rows if r["total_count"] > 0 and area in (None, r["area"])), key=order(key))
        assert got[u] == shown[:n]


def test_chart_and_plan(data):
    users, touched, defaults, full = data
    plan, chart = {}, {}
    for r in T.user_study_plan(users, touched, defaults).orderBy("rank").collect():
        plan.setdefault(r.user_id, []).append(r)
    for r in T.user_chart(users, touched, defaults, "recent", 5).orderBy("rank").collect():
        chart.setdefault(r.user_id, []).append(r)
    for u, rows in full.items():
        best = sorted(rows, key=order("priority"))[:3]
        assert [(r.slug, r.priority, r.bar) for r in plan[u]] == [(b["slug"], b["priority"], b["priority"] / max(0.01, best[0]["priority"])) for b in best]
        assert abs(plan[u][0].total_priority - sum(r["priority"] for r in rows)) < 1e-9
        best = sorted((r for r in rows if r["total_count"] > 0), key=order("recent"))[:5]
        peak = max(1.0, max(b["per_exam_recent"] for b in best))
        assert [(r.slug, r.value, r.bar) for r in chart[u]] == [(b["slug"], b["per_exam_recent"], b["per_exam_recent"] / peak) for b in best]

