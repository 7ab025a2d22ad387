"""The anchor steps do each piece of work once: equal margins are tried once, sections meet candidates, not words."""

from examloom.operators import sections as B
from examloom.operators import segment as O

WORDS = "doc_id BIGINT, page INT, word_no INT, text STRING, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE"


def page_words(spark):
    rows, no = [], 0
    for k in range(1, 31):
        x = 50.0 if k % 10 else 56.0  # few stand apart: dropped at tolerances 3 and 5, kept at 8 and 12
        for j, text in enumerate([f"{k}.", "some", "words", "here"]):
            y = k % 10 * 20.0
            rows.append((1, k // 10, no, text, x + 30 * j, y, x + 30 * j + 10, y + 10))
            no += 1
    return spark.createDataFrame(rows, WORDS)


def test_equal_margins_are_tried_once(spark):
    words = page_words(spark)
    every = O.trials(words)
    once = O.trials(words, distinct=True)
    assert {r.tol for r in every.collect()} == {3.0, 5.0, 8.0, 12.0}
    assert {r.tol for r in once.collect()} == {3.0, 8.0}
    best = lambda t: sorted(map(tuple, O.best_tolerance(O.trial_stats(t)).collect()))
    assert best(every) == best(once) and best(once)
    assert [r.number for r in O.find_anchors(words).orderBy("word_no").collect()] == list(range(1, 31))


def test_sections_meet_candidates_only(spark, monkeypatch):
    words = page_words(spark)
    met, real = [], B.on_pages
    monkeypatch.setattr(B, "on_pages", lambda rows, *a: met.append(rows) or real(rows, *a))
    parts = spark.createDataFrame(
        [(7, 2000, 1, 0, 2, None, "auto"), (8, 2000, 1, 2, None, None, "auto"), (9, 2000, 1, 1, 3, None, "dot")],
        "section_id BIGINT, year INT, doc_id BIGINT, page_from INT, page_to INT, area STRING, pattern STRING")
    tokens = spark.createDataFrame([], "doc_id BIGINT, page INT, pos INT, text STRING, left INT, top INT, width INT, height INT, block_num INT, line_num INT")
    got = {(r.doc_id, r.number) for r in B.section_anchors(words, tokens, parts).collect()}
    assert got == {(7, k) for k in range(1, 20)} | {(8, k) for k in range(20, 31)} | {(9, k) for k in range(10, 30)}
    assert all(df.count() <= 60 for df in met)  # 30 numbers under two patterns, of 120 words
