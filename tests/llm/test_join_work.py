"""How many rows the joins of near copies and near lines make."""

import random

from pyspark.sql import functions as F

from examloom.llm import graph, linededup, ngramjoin


def test_the_main_component_is_visited_and_does_not_visit(spark):
    """60 sets of one component and 6 others share a token, dealt to 6 blocks."""
    rows = [(1, s, 20, 0, 66, 0, 5, s % 6) for s in range(66)]
    kinds = "token long, sid long, n long, pos int, m long, before long, every long, block long"
    comp = spark.createDataFrame([(s, 0 if s < 60 else s) for s in range(66)], "sid long, comp long")
    got = ngramjoin.visiting(spark.createDataFrame(rows, kinds), comp, 80).collect()
    visits = {(r.sid, r.visit) for r in got}
    assert len(got) == len(visits) and {s for s, _ in visits} == set(range(60, 66))
    for a in range(66):
        for b in range(max(a + 1, 60), 66):
            assert a % 6 == b % 6 or (a, b % 6) in visits or (b, a % 6) in visits


def test_tokens_may_have_different_main_components(spark):
    """Component 0 is the larger one under token 1, component 100 under token 2."""
    sets = [(s, 0) for s in range(8)] + [(s, 100) for s in range(100, 108)]
    rows = [(1, s, 20, 0, 0, 0, 5, s % 4) for s, c in sets if c == 0 or s < 103]
    rows += [(2, s, 20, 0, 0, 0, 5, s % 4) for s, c in sets if c == 100 or s < 3]
    kinds = "token long, sid long, n long, pos int, m long, before long, every long, block long"
    comp = spark.createDataFrame(sets, "sid long, comp long")
    visits = {(r.sid, r.visit, r.token) for r in ngramjoin.visiting(spark.createDataFrame(rows, kinds), comp, 80).collect()}
    assert {(s, t) for s, _, t in visits} == {(s, 1) for s in (100, 101, 102)} | {(s, 2) for s in (0, 1, 2)}
    for token, s, *_ in rows:
        for other, x, *_ in rows:
            if token == other and s < 100 <= x and s % 4 != x % 4:
                assert (s, x % 4, token) in visits or (x, s % 4, token) in visits


def test_edges_inside_a_component_are_read_once(spark, monkeypatch):
    real, sizes = graph.materialize, []

    def materialize(df, name):
        out = real(df, name)
        if name == "edges":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(graph, "materialize", materialize)
    full = [(a, b) for a in range(30) for b in range(a)]
    chain = [(k, k + 1) for k in range(100, 160)]
    hubs = [(1000 + k // 5, 300 + k) for k in range(50)] + [(1001 + k, 304 + 5 * k) for k in range(9)]
    got = graph.components(spark.createDataFrame(full + chain + hubs, "a long, b long"), "a", "b")
    want = {k: 0 for k in range(30)} | {k: 100 for k in range(100, 161)}
    want |= {k: 300 for k in [*range(300, 350), *range(1000, 1010)]}
    assert {r.node: r.root for r in got.collect()} == want
    assert sizes[0] == len(full + chain + hubs) and sum(sizes) < 1.2 * sizes[0]


def test_simhashes_need_no_shuffle(spark):
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(words[:n]) for n in (1, 2, 126, 127, 128, 254, 255, 400)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = linededup.simhashes(docs, "text", ["doc_id"])
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    hashes = {r.w: r.h for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64(F.lit("word"), "w").alias("h")).collect()}
    for r in rows.collect():
        ws = texts[r.doc_id].split()
        want = sum(1 << b for b in range(64) if 2 * sum(hashes[w] >> b & 1 for w in ws) > len(ws))
        assert r.sim % 2**64 == want


def test_lines_that_meet_none_are_dropped_first(spark):
    rng = random.Random(5)
    lone = [(k, rng.getrandbits(64) - 2**63, 50) for k in range(40)]
    rows = [*lone, (100, 7, 50), (101, 6, 50), (102, 7, 90)]
    got = linededup.meeting(spark.createDataFrame(rows, "lid long, sim long, len int"), 3, 90)
    left = {r.lid for r in got.collect()}
    assert {100, 101} <= left and len(left) < 12
