"""The section table: page ranges, areas, forced and scanned patterns, key pages."""

from examloom.operators import sections as B

WORDS = "doc_id BIGINT, page INT, word_no INT, text STRING, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE"
TOKENS = "doc_id BIGINT, page INT, pos INT, text STRING, left INT, top INT, width INT, height INT, block_num INT, line_num INT"
SECTIONS = "section_id BIGINT, year INT, doc_id BIGINT, page_from INT, page_to INT, area STRING, pattern STRING"


def test_two_sections_of_one_document(spark):
    # pages 0 and 1: items 1. to 16. ; pages 2 and 3: items 17) to 20) with stray bare numbers; document 2 was scanned
    words, n = [], 0
    for k in range(1, 21):
        mark = f"{k}." if k <= 16 else f"{k})"
        for text, x in ((mark, 50.0), ("text", 90.0), (str(90 - k), 300.0)):
            page = (k - 1) // 8 if k <= 16 else 2 + (k - 17) // 2
            words.append((1, page, n, text, x, 50.0 + 18 * ((k - 1) % 8), x + 9, 60.0 + 18 * ((k - 1) % 8)))
            n += 1
    tokens = []
    for k in range(1, 7):
        top, left = 100 * k, 104 if k < 6 else 900  # the last one is far from the margin
        tokens += [(2, 0, 3 * k, f" {k}", left, top, 18, 24, 0, k), (2, 0, 3 * k + 1, "-", left + 25, top, 9, 24, 0, k), (2, 0, 3 * k + 2, "word", 400, top, 60, 24, 0, k)]
    tokens += [(2, 0, 50, "3.", 105, 302, 18, 24, 0, 3)]  # struck twice
    sections = [
        (10, 2002, 1, 0, 2, "matematica", "auto"), (11, 2002, 1, 2, None, None, "bare"), (12, 2002, 1, 2, 3, "fundamentos", "paren"),
        (13, 2003, 2, 0, None, "tecnologia", "ocr"), (14, 2003, 9, 0, None, None, "auto"),
    ]
    w, t, s = (spark.createDataFrame(x, y) for x, y in ((words, WORDS), (tokens, TOKENS), (sections, SECTIONS)))
    anchors = B.section_anchors(w, t, s)
    got = {}
    for r in anchors.orderBy("page", "y0").collect():
        got.setdefault((r.doc_id, r.pattern), []).append(r.number)
    # 12 has only two anchors on its page, fewer than a margin needs; the forced `bare` takes the strays
    assert got == {(10, "dot"): list(range(1, 17)), (11, "bare"): [73, 72, 71, 70], (13, "ocr"): [1, 2, 3, 4, 5]}
    items = B.year_items(anchors, s)
    areas = {(r.section_id, r.area) for r in items.collect()}
    assert areas == {(10, "matematica"), (11, "desconhecida"), (11, "tecnologia"), (13, "tecnologia")}

    pages = spark.createDataFrame([(5, 0, "1. (A)\n2. (B)"), (5, 1, "1. (E)\n2. (E)"), (6, 0, "1. (C)")], "doc_id BIGINT, page INT, text STRING")
    ranges = spark.createDataFrame([(2002, 5, 1, 2), (2003, 6, 0, None)], "year INT, doc_id BIGINT, key_from INT, key_to INT")
    key = {(r.year, r.number): r.answer for r in B.year_keys(pages, ranges, items).collect()}
    assert key == {(2002, 1): "E", (2002, 2): "E", (2003, 1): "C"}
    none = spark.createDataFrame([], "id STRING, topics ARRAY<STRING>")
    bank = {(r.year, r.number): (r.area, r.answer) for r in B.build_bank(w, t, pages, s, ranges, none).collect()}
    assert len(bank) == 25 and bank[2002, 2] == ("matematica", "E") and bank[2003, 1] == ("tecnologia", "C")


def test_no_sections(spark):
    w, t, s = (spark.createDataFrame([], x) for x in (WORDS, TOKENS, SECTIONS))
    assert B.section_anchors(w, t, s).count() == 0
