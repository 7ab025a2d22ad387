"""Sections of exams: which pages of a document hold which part of a year, and what is known about it.

`sections(section_id, year, doc_id, page_from, page_to, area, pattern)`: pages [page_from, page_to) of a document (a null
`page_to`: to its end) hold one part; a null `area` leaves it to the item numbers; `pattern` is `auto`, one of the anchor
patterns, or `ocr` for pages that were only scanned. `key_pages(year, doc_id, key_from, key_to)`: the pages of the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import core as fx
from ..session import materialize
from . import answerkey as Q
from . import intervals
from . import segment as O

# Fixed value: the one margin tolerance for scanner tokens.
TOKEN_TOLERANCE = 8.0


def on_pages(rows: DataFrame, ranges: DataFrame, first: str, last: str, take: list[str]) -> DataFrame:
    """Rows (doc_id, page, ...) with the columns `take` of every page range of their document that holds their page.

    The ranges meet distinct pages first, so the words of a page need one equi-join.
    """
    pages = rows.select("doc_id", F.col("page").cast("bigint").alias("page")).distinct()
    spans = ranges.select("doc_id", *take, F.col(first).cast("bigint").alias("_from"), F.col(last).cast("bigint").alias("_to"))
    held = intervals.contain(pages, spans, ["doc_id"], "page", "_from", "_to").drop("_from", "_to")
    return rows.join(held, ["doc_id", "page"])


def in_sections(rows: DataFrame, sections: DataFrame) -> DataFrame:
    """Words or tokens of the sections; their `doc_id` becomes the section's id, so that all of `segment` works on sections."""
    rows = on_pages(rows, sections, "page_from", "page_to", ["section_id"])
    return rows.drop("doc_id").withColumnRenamed("section_id", "doc_id")


def section_trials(words: DataFrame, tokens: DataFrame, sections: DataFrame) -> DataFrame:
    """De-duplicated anchors of every section and pattern that the section's pattern lets in, with margins of their own.

    Sections hold whole pages, and candidates are found page by page: so they are found first, and only these few meet the
    sections, not all words.
    """
    wanted = sections.select(F.col("section_id").alias("doc_id"), F.col("pattern").alias("_wanted"))
    scanned = sections.filter("pattern = 'ocr'")
    c = materialize(O.candidates(words), "anchor-candidates")
    c = in_sections(c, sections.filter("pattern <> 'ocr'")).join(wanted, "doc_id")
    c = materialize(c.filter("_wanted in ('auto', pattern)").drop("_wanted"), "section-candidates")
    t = in_sections(materialize(O.token_anchors(tokens), "anchor-tokens"), scanned)
    t = t.withColumnRenamed("pos", "word_no").withColumn("pattern", F.lit("ocr")).withColumn("prank", F.lit(0))
    t = materialize(t.select(*c.columns), "section-tokens")
    parts = ((c, O.TOLERANCES), (t, [TOKEN_TOLERANCE]))
    near = [O.dedupe_near(O.within_margins(x, O.distinct_margins(O.margin_clusters(x, tuple(tols))))) for x, tols in parts]
    return near[0].unionByName(near[1])


def section_anchors(words: DataFrame, tokens: DataFrame, sections: DataFrame) -> DataFrame:
    """The item anchors of every section (its id as `doc_id`): by the forced pattern, else by the best one."""
    t = materialize(section_trials(words, tokens, sections), "section-trials")
    forced = sections.filter("pattern <> 'auto'").select(F.col("section_id").alias("doc_id"), F.col("pattern").alias("forced"))
    chosen = O.choose_pattern(O.best_tolerance(O.trial_stats(t)), forced).select(*O.TRIAL)
    return t.join(chosen, O.TRIAL, "left_semi").drop("tol", "prank")


def year_items(anchors: DataFrame, sections: DataFrame) -> DataFrame:
    """The items of every year from all its sections: year, section_id, number, area."""
    s = sections.select(F.col("section_id").alias("doc_id"), "year", F.col("area").alias("_area"))
    area = F.coalesce("_area", fx.area_for("number", "year"))
    return anchors.select("doc_id", "number").join(s, "doc_id").select(
        "year", F.col("doc_id").alias("section_id"), "number", area.alias("area")
    )


def year_keys(pages: DataFrame, key_pages: DataFrame, items: DataFrame) -> DataFrame:
    """The answer key of every year: the layout that covers most of its items, read from the key's pages only.

    `pages(doc_id, page, text)` holds printed keys. A key is a few pages long.
    """
    held = on_pages(pages, key_pages, "key_from", "key_to", ["year"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n")
    keys = held.groupBy(F.col("year").alias("doc_id")).agg(text.alias("text"))
    expected = items.select(F.col("year").alias("doc_id"), "number").distinct()
    return Q.parse_best(keys, expected).withColumnRenamed("doc_id", "year")


def build_bank(words: DataFrame, tokens: DataFrame, pages: DataFrame, sections: DataFrame, key_pages: DataFrame,
               previous: DataFrame) -> DataFrame:
    """From printed pages to bank rows: anchors by section, items with their areas, the year's key, earlier topics."""
    sections = materialize(sections, "sections")
    items = materialize(year_items(section_anchors(words, tokens, sections), sections), "year-items")
    return Q.assemble_bank(items, year_keys(pages, key_pages, items), previous)
