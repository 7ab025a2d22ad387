"""Segmentation and answer-key queries over the documents laid out as words."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import answerkey as Q
from ..operators import sections as B
from ..operators import segment as O
from ..session import materialize
from ..sources import adapters as A
from .registry import query
from .text import _fold_sql
from .views import VIEWS

VIEWS["v_words"] = ("", """SELECT doc_id, (i // 40)::INT AS page,
    (row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1)::INT AS word_no, text,
    CASE WHEN j = 0 THEN 50.0 + (i + 1) % 3 * 1.5 WHEN j < p THEN CASE st WHEN 2 THEN 62.0 WHEN 3 THEN 110.0
      ELSE 50.0 + (i + 1) % 3 * 1.5 END ELSE 130.0 + (j - p) * 20.0 END::DOUBLE AS x0,
    (i % 40 * 18.0 + 50.0)::DOUBLE + CASE WHEN st <= 1 AND j = 1 AND p = 2 THEN 0.4::DOUBLE ELSE 0 END AS y0
  FROM (SELECT doc_id, st, i, len(pre) AS p, unnest(pre || own) AS text, unnest(range(len(pre || own))) AS j
    FROM (SELECT doc_id, doc_id % 4 AS st, i, list_filter(string_split(line, ' '), lambda w: w <> '') AS own,
      CASE doc_id % 4 WHEN 2 THEN [(i + 1)::VARCHAR, '-'] WHEN 3 THEN ['▬QUESTÃO', (i + 1)::VARCHAR]
        ELSE list_resize([(i + 1) || dot, (i + 1) || dot], CASE WHEN (i + 1) % 7 = 0 THEN 2 ELSE 1 END) END AS pre
      FROM (SELECT *, CASE WHEN doc_id % 4 = 0 OR (doc_id % 8 = 1 AND i < 10) THEN '.' ELSE ')' END AS dot
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
          unnest(range(len(string_split(text, chr(10))))) AS i FROM documents))))""")

VIEWS["v_cand"] = ("v_words", rf"""SELECT doc_id, page, word_no, y0, x0, pattern, number::BIGINT AS number, prank FROM (
    SELECT *, regexp_extract(text, '^0*(\d{{1,2}})[.)]?$', 1) AS number, CASE pattern WHEN 'paren' THEN 1 ELSE 0 END AS prank
    FROM (SELECT *, CASE WHEN regexp_full_match(text, '0*\d{{1,2}}\.') THEN 'dot'
      WHEN regexp_full_match(text, '0*\d{{1,2}}\)') THEN 'paren'
      WHEN regexp_full_match(text, '0*\d{{1,2}}') THEN 'bare' END AS pattern FROM v_words) WHERE pattern IS NOT NULL)
  UNION ALL SELECT doc_id, page, word_no, y0, x0, 'dotparen', regexp_extract(text, '^0*(\d{{1,2}})', 1)::BIGINT,
    CASE WHEN text LIKE '%)' THEN 1 ELSE 0 END FROM v_words WHERE regexp_full_match(text, '0*\d{{1,2}}[.)]')
  UNION ALL SELECT doc_id, page, word_no, y0, x0, 'questao', regexp_extract(nxt, '^0*(\d+)', 1)::BIGINT, 0
  FROM (SELECT *, lead(text) OVER (PARTITION BY doc_id, page ORDER BY word_no) AS nxt FROM v_words)
  WHERE CASE WHEN length(text) >= 7 AND regexp_matches(nxt, '^\d') THEN upper({_fold_sql('text')}) LIKE '%QUESTAO' END""")
VIEWS["v_clusters"] = ("v_cand", """SELECT * EXCLUDE (best_size, best_k),
    CASE WHEN cluster = best_k THEN size >= 3 ELSE size >= greatest(5, 0.5::DOUBLE * best_size) END AS kept
  FROM (SELECT *, first(size) OVER w AS best_size, first(cluster) OVER w AS best_k FROM (
    SELECT *, sum(c) OVER (PARTITION BY doc_id, pattern, tol, cluster)::BIGINT AS size FROM (
      SELECT *, sum(jump) OVER (PARTITION BY doc_id, pattern, tol ORDER BY x0)::BIGINT AS cluster FROM (
        SELECT *, CASE WHEN x0 - lag(x0) OVER (PARTITION BY doc_id, pattern, tol ORDER BY x0) > tol THEN 1 ELSE 0 END AS jump
        FROM (SELECT doc_id, pattern, x0, count(*) AS c FROM v_cand GROUP BY ALL),
          (SELECT unnest([3.0, 5.0, 8.0, 12.0])::DOUBLE AS tol))))
    WINDOW w AS (PARTITION BY doc_id, pattern, tol ORDER BY size DESC, cluster
      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))""")
VIEWS["v_near"] = ("v_clusters v_cand", """SELECT doc_id, pattern, tol, page, word_no, y0, x0, number, prank,
    row_number() OVER (PARTITION BY doc_id, pattern, tol, page ORDER BY y0, prank, word_no) AS rn
  FROM v_cand JOIN (SELECT doc_id, pattern, x0, tol FROM v_clusters WHERE kept) USING (doc_id, pattern, x0)""")
VIEWS["v_fold"] = ("v_near", """SELECT *, TRUE AS keep, number AS last_n, y0 AS last_y FROM v_near WHERE rn = 1
  UNION ALL SELECT n.*, NOT (n.number = last_n AND abs(last_y - n.y0) <= 3),
    CASE WHEN n.number = last_n AND abs(last_y - n.y0) <= 3 THEN last_n ELSE n.number END,
    CASE WHEN n.number = last_n AND abs(last_y - n.y0) <= 3 THEN last_y ELSE n.y0 END
  FROM v_fold f JOIN v_near n ON n.doc_id = f.doc_id AND n.pattern = f.pattern AND n.tol = f.tol AND n.page = f.page
    AND n.rn = f.rn + 1""")
VIEWS["v_trials"] = ("v_fold", """SELECT doc_id, pattern, tol, page, word_no, y0, x0, number, prank,
    row_number() OVER (PARTITION BY doc_id, pattern, tol ORDER BY page, y0, prank, word_no) AS pos FROM v_fold WHERE keep""")
VIEWS["v_stats"] = ("v_trials", """SELECT doc_id, pattern, tol, count(*) AS n,
    count(*) >= 15 AND bool_and(number = pos) AS clean FROM v_trials GROUP BY ALL""")
VIEWS["v_best"] = ("v_stats", """SELECT * FROM v_stats QUALIFY row_number() OVER (PARTITION BY doc_id, pattern
    ORDER BY clean DESC, CASE WHEN clean THEN tol END, n DESC, tol) = 1""")
VIEWS["v_chosen"] = ("v_best", """SELECT * FROM v_best WHERE pattern <> 'questao' OR n >= 5
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pattern = 'questao' DESC, clean DESC, n DESC,
    list_position(['dot', 'paren', 'bare', 'dotparen'], pattern)) = 1""")
VIEWS["v_anchors"] = ("v_trials v_chosen", """SELECT doc_id, pattern, page, word_no, y0, x0, number,
    row_number() OVER (PARTITION BY doc_id ORDER BY page, y0, word_no) AS seg, count(*) OVER (PARTITION BY doc_id) AS total
  FROM v_trials SEMI JOIN v_chosen USING (doc_id, pattern, tol)""")


def words(spark, d):
    return A.words(spark, d)


@query("anchor_candidates", "v_cand", "SELECT doc_id, page, word_no, y0, x0, pattern, number FROM v_cand")
def anchor_candidates(spark, d):
    return O.candidates(words(spark, d)).select("doc_id", "page", "word_no", "y0", "x0", "pattern", "number")


@query("anchor_tokens", "v_words", r"""
WITH t AS (SELECT doc_id, page, word_no AS pos, trim(text) AS text, floor(x0 * 2)::INT AS lft, floor(y0 * 2)::INT AS top,
    floor((y0 - 50) / 18)::INT AS line FROM v_words),
  n AS (SELECT *, lead(text) OVER w AS nt, lead(lft) OVER w AS nl, lead(line) OVER w AS nline FROM t
    WINDOW w AS (PARTITION BY doc_id, page ORDER BY pos))
SELECT doc_id, page, pos, regexp_extract(text, '^(\d{1,2})', 1)::BIGINT AS number, lft / 2.0::DOUBLE AS x0, top / 2.0::DOUBLE AS y0
FROM n WHERE regexp_full_match(text, '\d{1,2}[.\-]')
  OR (regexp_full_match(text, '\d{1,2}') AND nt IN ('-', '.') AND line = nline AND nl - (lft + 18) BETWEEN 0 AND 20)""")
def anchor_tokens(spark, d):
    return O.token_anchors(A.ocr_tokens(spark, d)).drop("y1")


@query("gap_clusters", "v_clusters", """
SELECT doc_id, pattern, tol, cluster, any_value(size) AS size, min(x0) AS lo, max(x0) AS hi FROM v_clusters GROUP BY ALL""")
def gap_clusters(spark, d):
    return O.cluster_summary(O.margin_clusters(O.candidates(words(spark, d)))).drop("kept")


@query("dominant_clusters", "v_near", "SELECT doc_id, pattern, tol, page, word_no, number FROM v_near")
def dominant_clusters(spark, d):
    c = O.candidates(words(spark, d))
    return O.within_margins(c, O.margin_clusters(c)).select("doc_id", "pattern", "tol", "page", "word_no", "number")


@query("dedupe_near", "v_trials", "SELECT doc_id, pattern, tol, page, word_no, number FROM v_trials")
def dedupe_near(spark, d):
    return O.trials(words(spark, d)).select("doc_id", "pattern", "tol", "page", "word_no", "number")


@query("clean_sequence", "v_stats", "SELECT * FROM v_stats")
def clean_sequence(spark, d):
    return O.trial_stats(materialize(O.trials(words(spark, d)), "anchor-trials"))


@query("best_tolerance", "v_best", "SELECT * FROM v_best")
def best_tolerance(spark, d):
    return O.best_tolerance(O.trial_stats(materialize(O.trials(words(spark, d), distinct=True), "anchor-trials")))


@query("choose_anchors", "v_anchors", "SELECT doc_id, pattern, page, word_no, y0, x0, number FROM v_anchors")
def choose_anchors(spark, d):
    return O.find_anchors(words(spark, d)).drop("y1")


SEGMENTS_SQL = """SELECT doc_id, number, page, y0, word_no, lead(page) OVER w AS end_page, lead(y0) OVER w AS end_y
  FROM v_anchors WINDOW w AS (PARTITION BY doc_id ORDER BY seg)"""


@query("segments", "v_anchors", SEGMENTS_SQL)
def segments(spark, d):
    return O.segments(O.find_anchors(words(spark, d)))


@query("segment_outliers", "v_anchors", f"""
WITH s AS ({SEGMENTS_SQL}), h AS (SELECT doc_id, number, page, floor(CASE WHEN coalesce(end_page, page) = page
    THEN coalesce(end_y, 842.0::DOUBLE) - (y0 - 4)
    ELSE 842.0::DOUBLE - (y0 - 4) + (end_page - page - 1) * 842.0::DOUBLE + end_y END * 150.0::DOUBLE / 72)::BIGINT AS height_px FROM s)
SELECT *, CASE WHEN height_px < 80 THEN 'short' ELSE 'tall' END AS flag FROM h WHERE height_px < 80 OR height_px > 2500""")
def segment_outliers(spark, d):
    return O.outliers(O.segments(O.find_anchors(words(spark, d))))


@query("segment_text", "v_anchors v_words", f"""
WITH s AS (SELECT a.*, lead(page) OVER w AS ep, lead(y0) OVER w AS ey FROM v_anchors a WINDOW w AS (PARTITION BY doc_id ORDER BY seg))
SELECT doc_id, seg, number, string_agg(text, ' ' ORDER BY w.word_no) AS text
FROM s JOIN (SELECT doc_id, page AS wp, y0 AS wy, word_no, text FROM v_words) w USING (doc_id)
WHERE (wp > page OR (wp = page AND wy >= s.y0 - 4))
  AND CASE WHEN ep IS NULL THEN wp = page ELSE wp < ep OR (wp = ep AND wy < ey) END
GROUP BY ALL""")
def segment_text(spark, d):
    w = words(spark, d)
    return O.segment_text(w, O.find_anchors(w))


@query("sequence_gaps", "v_anchors", """
WITH per AS (SELECT doc_id, number, count(*) AS c, lag(number) OVER (PARTITION BY doc_id ORDER BY number) AS p
    FROM v_anchors GROUP BY doc_id, number),
  ok AS (SELECT doc_id, bool_and(number = seg) AS sequence_ok FROM v_anchors GROUP BY doc_id)
SELECT doc_id, sum(c)::BIGINT AS n, min(number) AS first, max(number) AS last,
  sum(CASE WHEN number - p > 1 THEN number - p - 1 ELSE 0 END)::BIGINT AS missing,
  coalesce(string_agg((p + 1) || '-' || (number - 1), ',' ORDER BY p) FILTER (number - p > 1), '') AS missing_ranges,
  count(*) FILTER (c > 1) AS dupes, any_value(sequence_ok) AS sequence_ok
FROM per JOIN ok USING (doc_id) GROUP BY doc_id""")
def sequence_gaps(spark, d):
    return O.sequence_gaps(materialize(O.find_anchors(words(spark, d)), "anchors"))


# ---------------------------------------------------------------- answer keys

VIEWS["v_key_text"] = ("", r"""SELECT doc_id, CASE doc_id % 3
    WHEN 0 THEN array_to_string(list_transform(ls, lambda l, i: i || '. (' || substr('ABCDE*', (length(l) % 6 + 1)::INT, 1) || ')'), chr(10))
    WHEN 1 THEN array_to_string(list_transform(ls, lambda l, i: CASE WHEN i < 10 THEN CASE WHEN doc_id % 2 = 0 THEN '0' ELSE 'o' END ELSE '' END
      || i || ' - ' || substr('ABCDE*', (length(l) % 6 + 1)::INT, 1)), ' ')
    ELSE array_to_string(list_transform(range(1, len(ls) + 1, 10), lambda s:
      array_to_string(range(s, least(s + 10, len(ls) + 1)), ' ') || chr(10)
      || array_to_string(list_transform(ls[s:s + 9], lambda l: substr('ABCDE*', (length(l) % 6 + 1)::INT, 1)), ' ')), chr(10)) END AS text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)""")
VIEWS["v_repaired"] = ("v_key_text", r"""SELECT doc_id, regexp_replace(text, '(?i)\bo(\d)', '0\1', 'g') AS text FROM v_key_text""")


def _key_sql(matches: str) -> str:
    return f"""SELECT doc_id, number, CASE WHEN upper(raw) NOT IN ('*', '∗', 'ANULADA', 'NULA') THEN upper(raw) END AS answer,
      upper(raw) IN ('*', '∗', 'ANULADA', 'NULA') AS annulled
    FROM ({matches}) QUALIFY row_number() OVER (PARTITION BY doc_id, number ORDER BY pos) = 1"""


def _regex_sql(p: str) -> str:
    return f"""SELECT doc_id, unnest(regexp_extract_all(text, '{p}', 1))::BIGINT AS number, unnest(regexp_extract_all(text, '{p}', 2)) AS raw,
      unnest(range(len(regexp_extract_all(text, '{p}', 1)))) AS pos FROM v_repaired"""


VIEWS["v_key_lines"] = ("v_repaired", _key_sql(_regex_sql(Q.LINE.replace("(?imd)", "(?im)"))))
VIEWS["v_key_inline"] = ("v_repaired", _key_sql(_regex_sql(Q.INLINE)))
VIEWS["v_key_pairs"] = ("v_repaired", _key_sql(r"""SELECT doc_id, i * 1000 + k AS pos, nums[k]::BIGINT AS number, ans[k] AS raw FROM (
    SELECT doc_id, i, nums, ans, unnest(range(1, len(nums) + 1)) AS k FROM (
      SELECT doc_id, i, list_filter(regexp_split_to_array(ls[i], '\s+'), lambda t: t <> '') AS nums,
        list_filter(regexp_split_to_array(ls[i + 1], '\s+'), lambda t: t <> '') AS ans
      FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))))) AS i FROM v_repaired))
    WHERE len(nums) >= 5 AND len(nums) = len(ans)
      AND len(list_filter(nums, lambda t: regexp_full_match(t, '\d{1,2}'))) = len(nums)
      AND len(list_filter(ans, lambda t: regexp_full_match(t, '[A-Ea-e*∗]'))) = len(ans))"""))
VIEWS["v_expected"] = ("", """SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS number FROM documents""")
VIEWS["v_key"] = ("v_key_lines v_key_pairs v_key_inline v_expected", """SELECT doc_id, number, answer, annulled, method, overlap FROM (
    SELECT *, 0 AS i, 'lines' AS method FROM v_key_lines UNION ALL SELECT *, 1, 'pairs' FROM v_key_pairs
    UNION ALL SELECT *, 2, 'inline' FROM v_key_inline)
  JOIN (SELECT doc_id, i, overlap FROM (
      SELECT doc_id, i, count(e.number) AS overlap FROM (SELECT doc_id, number, 0 AS i FROM v_key_lines
        UNION ALL SELECT doc_id, number, 1 FROM v_key_pairs UNION ALL SELECT doc_id, number, 2 FROM v_key_inline) k
      LEFT JOIN v_expected e USING (doc_id, number) GROUP BY doc_id, i
      UNION ALL SELECT DISTINCT doc_id, 0, 0 FROM (SELECT doc_id FROM v_key_lines UNION ALL SELECT doc_id FROM v_key_pairs
        UNION ALL SELECT doc_id FROM v_key_inline))
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY overlap DESC, i) = 1) USING (doc_id, i)""")


def keys(spark, d):
    return A.key_text(spark, d).withColumn("text", Q.repair("text"))


def expected(spark, d):
    return A.lines(spark, d).select("doc_id", (F.col("i") + 1).cast("bigint").alias("number"))


query("key_lines", "v_key_lines", "SELECT * FROM v_key_lines")(lambda spark, d: Q.parse_lines(keys(spark, d)))
query("key_inline", "v_key_inline", "SELECT * FROM v_key_inline")(lambda spark, d: Q.parse_inline(keys(spark, d)))
query("key_pairs", "v_key_pairs", "SELECT * FROM v_key_pairs")(lambda spark, d: Q.parse_pairs(keys(spark, d)))


@query("key_best", "v_key", "SELECT * FROM v_key")
def key_best(spark, d):
    return Q.parse_best(keys(spark, d), expected(spark, d))


# items are the anchors actually found, so both kinds of mismatch occur
@query("key_reconcile", "v_key v_anchors", """
SELECT doc_id, number, CASE WHEN k.method IS NULL THEN 'missing_answer' WHEN i.found IS NULL THEN 'extra_answer' ELSE 'ok' END AS status,
  answer, coalesce(annulled, FALSE) AS annulled
FROM (SELECT DISTINCT doc_id, number, TRUE AS found FROM v_anchors) i FULL JOIN v_key k USING (doc_id, number)""")
def key_reconcile(spark, d):
    found = O.find_anchors(words(spark, d)).select("doc_id", "number").distinct()
    return Q.reconcile(found, Q.parse_best(keys(spark, d), expected(spark, d)))


# ---------------------------------------------------------------- sections

VIEWS["v_sections"] = ("", """SELECT doc_id * 2 + k AS section_id, doc_id::INT AS year, doc_id, CASE WHEN k = 0 THEN 0 ELSE mid END AS page_from,
    CASE WHEN k = 0 THEN mid END AS page_to, CASE WHEN k = 0 AND doc_id % 3 = 0 THEN 'matematica' END AS area,
    CASE WHEN doc_id % 4 <> 2 THEN 'auto' WHEN k = 0 THEN 'ocr' ELSE 'bare' END AS pattern
  FROM (SELECT doc_id, greatest(1, n // 2)::BIGINT AS mid, unnest(CASE WHEN n > 1 THEN [0, 1] ELSE [0] END) AS k
    FROM (SELECT doc_id, ceil(len(string_split(text, chr(10))) / 40)::BIGINT AS n FROM documents) WHERE n > 0)""")
VIEWS["v_swords"] = ("v_words v_sections", """SELECT s.section_id AS doc_id, w.page, word_no, text, x0, y0
  FROM v_words w JOIN v_sections s ON s.doc_id = w.doc_id AND w.page >= s.page_from AND (s.page_to IS NULL OR w.page < s.page_to)""")
VIEWS["v_stokens"] = ("v_swords", r"""SELECT doc_id, page, word_no, y0, x0, 'ocr' AS pattern, number, 0 AS prank FROM (
    SELECT doc_id, page, pos AS word_no, regexp_extract(text, '^(\d{1,2})', 1)::BIGINT AS number, lft / 2.0::DOUBLE AS x0, top / 2.0::DOUBLE AS y0
    FROM (SELECT *, lead(text) OVER w AS nt, lead(lft) OVER w AS nl, lead(line) OVER w AS nline
      FROM (SELECT doc_id, page, word_no AS pos, trim(text) AS text, floor(x0 * 2)::INT AS lft, floor(y0 * 2)::INT AS top,
        floor((y0 - 50) / 18)::INT AS line FROM v_swords)
      WINDOW w AS (PARTITION BY doc_id, page ORDER BY pos))
    WHERE regexp_full_match(text, '\d{1,2}[.\-]')
      OR (regexp_full_match(text, '\d{1,2}') AND nt IN ('-', '.') AND line = nline AND nl - (lft + 18) BETWEEN 0 AND 20))""")


def _of_sections(name: str) -> None:
    """The view of a step on sections: the same text over the sections' words, tokens joining the candidates."""
    deps, body = VIEWS[name]
    for step in ("words", "cand", "clusters", "near", "fold", "trials", "stats", "best"):
        deps, body = (re.sub(rf"\bv_{step}\b", f"v_s{step}", x) for x in (deps, body))
    VIEWS[name.replace("v_", "v_s")] = deps, body


for _name in ("v_cand", "v_clusters", "v_near", "v_fold", "v_trials", "v_stats", "v_best"):
    _of_sections(_name)
VIEWS["v_scand"] = ("v_swords v_stokens v_sections", f"""SELECT c.* FROM ({VIEWS["v_scand"][1]} UNION ALL SELECT * FROM v_stokens) c
  JOIN v_sections s ON s.section_id = c.doc_id AND (s.pattern = c.pattern OR (s.pattern = 'auto' AND c.pattern <> 'ocr'))""")
VIEWS["v_sclusters"] = (VIEWS["v_sclusters"][0], VIEWS["v_sclusters"][1].replace(
    "(SELECT unnest([3.0, 5.0, 8.0, 12.0])::DOUBLE AS tol)", "(SELECT unnest([3.0, 5.0, 8.0, 12.0])::DOUBLE AS tol) WHERE pattern <> 'ocr' OR tol = 8"))
VIEWS["v_schosen"] = ("v_sbest v_sections", """SELECT b.* FROM v_sbest b JOIN v_sections s ON s.section_id = b.doc_id
  WHERE s.pattern <> 'auto' OR b.pattern <> 'questao' OR n >= 5
  QUALIFY row_number() OVER (PARTITION BY b.doc_id ORDER BY b.pattern = 'questao' DESC, clean DESC, n DESC,
    list_position(['dot', 'paren', 'bare', 'dotparen'], b.pattern)) = 1""")
VIEWS["v_sanchors"] = ("v_strials v_schosen", """SELECT doc_id, pattern, page, word_no, y0, x0, number
  FROM v_strials SEMI JOIN v_schosen USING (doc_id, pattern, tol)""")
VIEWS["v_items_of_year"] = ("v_sanchors v_sections", """SELECT s.year, s.section_id, a.number, coalesce(s.area,
    CASE WHEN number BETWEEN 1 AND 20 THEN 'matematica' WHEN number BETWEEN 21 AND CASE WHEN s.year <= 2007 THEN 40 ELSE 50 END THEN 'fundamentos'
      WHEN number BETWEEN 21 AND 70 THEN 'tecnologia' ELSE 'desconhecida' END) AS area
  FROM v_sanchors a JOIN v_sections s ON s.section_id = a.doc_id""")
# the key's text is that of its pages: one edition, the other, or one after the other
VIEWS["v_repaired_pages"] = ("v_key_text", r"""SELECT doc_id, regexp_replace(CASE WHEN doc_id % 5 = 0 THEN text || chr(10) || other
    WHEN doc_id % 2 = 0 THEN text ELSE other END, '(?i)\bo(\d)', '0\1', 'g') AS text
  FROM (SELECT *, regexp_replace(text, '\b[A-D]\b', 'E', 'g') AS other FROM v_key_text WHERE text IS NOT NULL)""")
VIEWS["v_year_numbers"] = ("v_items_of_year", "SELECT DISTINCT year::BIGINT AS doc_id, number FROM v_items_of_year")
for _name in ("v_key_lines", "v_key_inline", "v_key_pairs", "v_key"):
    _deps, _body = VIEWS[_name]
    for _old, _new in (("v_repaired", "v_repaired_pages"), ("v_expected", "v_year_numbers"), ("v_key_lines", "v_ykey_lines"),
                       ("v_key_inline", "v_ykey_inline"), ("v_key_pairs", "v_ykey_pairs")):
        _deps, _body = (re.sub(rf"\b{_old}\b", _new, x) for x in (_deps, _body))
    VIEWS[_name.replace("v_key", "v_ykey")] = _deps, _body


def section_anchors(spark, d):
    return B.section_anchors(words(spark, d), A.ocr_tokens(spark, d), materialize(A.sections(spark, d), "sections"))


# section ids stand in doc_id
query("section_anchors", "v_sanchors", "SELECT * FROM v_sanchors")(lambda spark, d: section_anchors(spark, d).drop("y1"))


@query("section_segments", "v_sanchors", """
SELECT doc_id, number, page, y0, word_no, lead(page) OVER w AS end_page, lead(y0) OVER w AS end_y
FROM v_sanchors WINDOW w AS (PARTITION BY doc_id ORDER BY page, y0, word_no)""")
def section_segments(spark, d):
    return O.segments(materialize(section_anchors(spark, d), "anchors"))


@query("section_items", "v_items_of_year", "SELECT * FROM v_items_of_year")
def section_items(spark, d):
    return B.year_items(section_anchors(spark, d), A.sections(spark, d))


# documents stand for exam years: sections give items and areas, a range of pages the key
@query("assemble_bank", "v_ykey v_items_of_year v_classified", """
SELECT printf('%d-%02d', i.year, number) AS id, i.year, number, area,
  printf('questions/%d/q%02d.webp', i.year, number) AS image, answer, coalesce(annulled, FALSE) AS annulled,
  CASE WHEN number = 1 THEN coalesce(topics, '') ELSE '' END AS topics
FROM (SELECT *, year::BIGINT AS doc_id FROM v_items_of_year) i LEFT JOIN v_ykey USING (doc_id, number) LEFT JOIN v_classified USING (doc_id)""")
def assemble_bank(spark, d):
    from ..functions import core as fx
    from .text import classified

    pages = A.key_pages(spark, d).withColumn("text", Q.repair("text"))
    prev = classified(spark, d).select(fx.item_id("doc_id", F.lit(1)).alias("id"), "topics")
    bank = B.build_bank(words(spark, d), A.ocr_tokens(spark, d), pages, A.sections(spark, d), A.key_ranges(spark, d), prev)
    return bank.withColumn("topics", F.concat_ws("+", "topics"))
