"""Numbered items in positioned words: candidates, margin clusters, de-duplication, best trial, segments.

Input `words(doc_id, page, word_no, text, x0, y0, x1, y1)`, `word_no` consecutive in reading order.
Candidates are a small share of the words and every later step works on them only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import materialize
from . import slices

# Margin tolerances in points, double-strike tolerance, minimum clean run.
TOLERANCES = [3.0, 5.0, 8.0, 12.0]
STRIKE_TOLERANCE = 3.0
MIN_CLEAN = 15
MIN_WORD_ANCHORS = 5
MAX_TOKEN_GAP = 20
PATTERNS = ["dot", "paren", "bare", "dotparen"]  # after the word pattern, in order of preference

TRIAL = ["doc_id", "pattern", "tol"]


def candidates(words: DataFrame) -> DataFrame:
    """Anchor candidates of every pattern.

    One narrow pass keeps tokens that start with a digit or end with the item word; only those few
    are shuffled (by page) to pair the item word with the number right after it.
    """
    box = ["doc_id", "page", "word_no", "y0", "y1", "x0"]
    text = F.col("text")
    # Folding leaves ASCII as it is and is left to the few words that may end with the item word when folded.
    ascii_only = F.octet_length(text) == F.length(text)
    last = F.substring(text, -1, 1)
    folds = ~ascii_only & (F.octet_length(text) >= 7) & (last.isin("o", "O") | (F.octet_length(last) > 1))
    maybe = folds | (ascii_only & F.endswith(F.upper(text), F.lit("QUESTAO")))
    head = (F.length(text) >= 7) & F.endswith(F.upper(tx.fold(text)), F.lit("QUESTAO"))
    sparse = (
        words.select(*box, "text")
        .filter(F.substring(text, 1, 1).between("0", "9") | maybe)
        .withColumn("_lead", F.regexp_extract(text, r"^0*(\d+)", 1).try_cast("bigint"))
    )
    w = W.partitionBy("doc_id", "page").orderBy("word_no")
    sparse = sparse.withColumn("_next", F.lead(F.struct("word_no", "_lead")).over(w)).withColumn("_head", head)
    adjacent = (F.col("_next.word_no") == F.col("word_no") + 1) & F.col("_next._lead").isNotNull()
    patterns = (
        F.when(F.col("_head"), F.when(adjacent, F.array(F.lit("questao"))))
        # "dot" and "paren" also feed one combined candidate list
        .when(text.rlike(r"^0*\d{1,2}\.$"), F.array(F.lit("dot"), F.lit("dotparen")))
        .when(text.rlike(r"^0*\d{1,2}\)$"), F.array(F.lit("paren"), F.lit("dotparen")))
        .when(text.rlike(r"^0*\d{1,2}$"), F.array(F.lit("bare")))
    )
    short = F.regexp_extract(text, r"^0*(\d{1,2})[.)]?$", 1).try_cast("bigint")
    return sparse.select(
        *box,
        F.explode(patterns).alias("pattern"),
        F.when(F.col("_head"), F.col("_next._lead")).otherwise(short).alias("number"),
        F.when(text.endswith(")"), 1).otherwise(0).alias("prank"),
    )


def token_anchors(tokens: DataFrame, scale: float = 2.0) -> DataFrame:
    """Anchors in scanner tokens: `21.`/`21-`, or `21` with a dash or dot right after it on its line."""
    t = F.col("_t")
    sparse = tokens.withColumn("_t", F.trim("text"))
    sparse = sparse.filter((F.length(t) <= 5) & t.rlike(r"^(?:\d{1,2}[.\-]?|[.\-])$"))  # long words without the regex
    w = W.partitionBy("doc_id", "page").orderBy("pos")
    nxt = F.lead(F.struct("pos", "_t", "block_num", "line_num", "left")).over(w)
    sparse = sparse.withColumn("_n", nxt)
    gap = F.col("_n.left") - (F.col("left") + F.col("width"))
    followed = (
        t.rlike(r"^\d{1,2}$")
        & (F.col("_n.pos") == F.col("pos") + 1)
        & F.col("_n._t").isin("-", ".")
        & (F.col("_n.block_num") == F.col("block_num"))
        & (F.col("_n.line_num") == F.col("line_num"))
        & gap.between(0, MAX_TOKEN_GAP)
    )
    return sparse.filter(t.rlike(r"^\d{1,2}[.\-]$") | followed).select(
        "doc_id",
        "page",
        "pos",
        F.regexp_extract("_t", r"^(\d{1,2})", 1).cast("bigint").alias("number"),
        (F.col("left") / scale).alias("x0"),
        (F.col("top") / scale).alias("y0"),
        ((F.col("top") + F.col("height")) / scale).alias("y1"),
    )


def margin_clusters(cands: DataFrame, tolerances=tuple(TOLERANCES)) -> DataFrame:
    """Left margins per (doc, pattern, tolerance): cluster of every distinct x0 and whether it is kept.

    Works on distinct positions with their counts, so the ordered windows see one row per margin
    position of a page layout, not one per word. The largest cluster (leftmost on ties) is kept
    when it has at least three anchors, others from half its size (five at least). As clusters are
    more than the tolerance apart, an anchor lies within reach of a kept cluster only if it is in it.
    """
    xs = cands.groupBy("doc_id", "pattern", "x0").agg(F.count("*").alias("c"))
    grid = xs.withColumn("tol", F.explode(F.array(*[F.lit(t) for t in tolerances])))
    w = W.partitionBy(*TRIAL).orderBy("x0")
    gap = F.coalesce(F.col("x0") - F.lag("x0").over(w) > F.col("tol"), F.lit(False))
    grid = grid.withColumn("_new", gap.cast("int")).withColumn("cluster", F.sum("_new").over(w))
    whole = W.partitionBy(*TRIAL)
    grid = grid.withColumn("size", F.sum("c").over(W.partitionBy(*TRIAL, "cluster")))
    grid = grid.withColumn("_top", F.max(F.struct("size", (-F.col("cluster")).alias("k"))).over(whole))
    best = F.col("cluster") == -F.col("_top.k")
    keep = F.when(best, F.col("size") >= 3).otherwise(F.col("size") >= F.greatest(F.lit(5.0), 0.5 * F.col("_top.size")))
    return grid.withColumn("kept", keep).drop("_new", "_top")


def cluster_summary(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy(*TRIAL, "cluster").agg(
        F.sum("c").alias("size"), F.min("x0").alias("lo"), F.max("x0").alias("hi"), F.first("kept").alias("kept")
    )


def within_margins(cands: DataFrame, clusters: DataFrame) -> DataFrame:
    kept = clusters.filter("kept").select("doc_id", "pattern", "x0", "tol")
    return cands.join(kept, ["doc_id", "pattern", "x0"])


def dedupe_near(anchors: DataFrame, keys=tuple(TRIAL), tolerance: float = STRIKE_TOLERANCE) -> DataFrame:
    """Drop an anchor that repeats the number of the last kept one on its page within `tolerance` points.

    A chain compares with the last *kept* anchor, hence a fold; it restarts on every page, so the
    folded arrays hold the anchors of one printed page.
    """
    rest = [c for c in anchors.columns if c not in (*keys, "page", "y0", "prank", "word_no")]
    item = F.struct("y0", "prank", "word_no", *rest)
    pages = anchors.groupBy(*keys, "page").agg(F.array_sort(F.collect_list(item)).alias("_a"))

    def keep(acc, e):
        last = F.try_element_at(acc, F.lit(-1))
        again = (last["number"] == e["number"]) & (F.abs(last["y0"] - e["y0"]) <= tolerance)
        return F.when(F.coalesce(again, F.lit(False)), acc).otherwise(F.concat(acc, F.array(e)))

    kept = F.aggregate("_a", F.filter("_a", lambda e: F.lit(False)), keep)
    out = pages.select(*keys, "page", F.explode_outer(kept).alias("_e"))
    return out.select(*keys, "page", "_e.*")


def trial_stats(anchors: DataFrame) -> DataFrame:
    """Length of every trial and whether its numbers run 1..n in order (n >= 15)."""
    seq = slices.neighbours(anchors, TRIAL, "page", ["y0", "prank", "word_no"], lag={"_before": "number"})
    broken = F.count_if(F.col("number") != F.coalesce("_before", F.lit(0)) + 1)
    stats = seq.groupBy(*TRIAL).agg(F.count("*").alias("n"), broken.alias("_broken"))
    return stats.select(*TRIAL, "n", ((F.col("n") >= MIN_CLEAN) & (F.col("_broken") == 0)).alias("clean"))


def best_tolerance(stats: DataFrame) -> DataFrame:
    """Per (doc, pattern): the first clean tolerance, else the first longest."""
    score = F.struct(
        F.col("clean"), F.when(F.col("clean"), -F.col("tol")).otherwise(F.col("n").cast("double")), -F.col("tol")
    )
    best = stats.groupBy("doc_id", "pattern").agg(F.max_by(F.struct("tol", "n", "clean"), score).alias("_b"))
    return best.select("doc_id", "pattern", "_b.*")


def choose_pattern(best: DataFrame, forced: DataFrame | None = None) -> DataFrame:
    """Per document: the word pattern from five anchors on, else the longest clean list, else the longest.

    `forced` (doc_id, forced) names the pattern of some documents, which is then taken however many anchors it has.
    """
    usable = (F.col("pattern") != "questao") | (F.col("n") >= MIN_WORD_ANCHORS)
    if forced is not None:
        best = best.join(forced, "doc_id", "left")
        usable = F.coalesce(F.col("forced") == F.col("pattern"), usable)
    usable = best.filter(usable)
    order = F.array_position(F.array(*[F.lit(p) for p in PATTERNS]), F.col("pattern"))
    score = F.struct(F.col("pattern") == "questao", "clean", "n", -order)
    c = usable.groupBy("doc_id").agg(F.max_by(F.struct("pattern", "tol", "n", "clean"), score).alias("_c"))
    return c.select("doc_id", "_c.*")


def distinct_margins(clusters: DataFrame) -> DataFrame:
    """The kept margins of the first tolerance only, where several keep the same ones.

    Their trials are equal, and of equal trials the first tolerance is the best.
    """
    sets = clusters.filter("kept").groupBy(*TRIAL).agg(F.array_sort(F.collect_list("x0")).alias("_xs"))
    firsts = sets.groupBy("doc_id", "pattern", "_xs").agg(F.min("tol").alias("tol"))
    return firsts.select(*TRIAL, F.explode_outer("_xs").alias("x0"), F.lit(True).alias("kept"))


def trials(words: DataFrame, distinct: bool = False) -> DataFrame:
    """De-duplicated anchors of every (doc, pattern, tolerance), or only of tolerances with margins of their own."""
    c = materialize(candidates(words), "anchor-candidates")
    margins = margin_clusters(c)
    return dedupe_near(within_margins(c, distinct_margins(margins) if distinct else margins))


def find_anchors(words: DataFrame) -> DataFrame:
    """The item anchors of every document."""
    t = materialize(trials(words, distinct=True), "anchor-trials")
    chosen = choose_pattern(best_tolerance(trial_stats(t))).select(*TRIAL)
    return t.join(chosen, TRIAL, "left_semi").drop("tol", "prank")


def segments(anchors: DataFrame) -> DataFrame:
    """Each anchor up to the next one of its document (nulls on the last)."""
    a = slices.neighbours(
        anchors.withColumn("_page", F.col("page")), ["doc_id"], "page", ["y0", "word_no"],
        lead={"end_page": "_page", "end_y": "y0"},
    )
    return a.select("doc_id", "number", "page", "y0", "word_no", "end_page", "end_y")


def outliers(segs: DataFrame, page_height: float = 842.0, dpi: float = 150.0) -> DataFrame:
    """Items whose region is suspiciously short or tall, in pixels at the given resolution."""
    top = F.col("y0") - 4
    last = F.coalesce("end_page", "page")
    end = F.coalesce("end_y", F.lit(page_height))
    height = F.when(last == F.col("page"), end - top).otherwise(
        page_height - top + (last - F.col("page") - 1) * page_height + end
    )
    px = F.floor(height * dpi / 72)
    s = segs.withColumn("height_px", px.cast("bigint"))
    flag = F.when(F.col("height_px") < 80, F.lit("short")).when(F.col("height_px") > 2500, F.lit("tall"))
    return s.withColumn("flag", flag).filter("flag is not null").select("doc_id", "number", "page", "height_px", "flag")


def regions(anchors: DataFrame) -> DataFrame:
    """Item regions per page, as one array of (seg, number, top, bottom) per (doc, page).

    From four points above the anchor to the next anchor: the rest of the first page, whole pages
    in between, the top of the last one. The last item of a document ends with its page. The arrays
    hold the items printed on one page.
    """
    numbered = slices.rank(anchors, ["doc_id"], "page", ["y0", "word_no"], out="seg")
    segs = segments(anchors).join(numbered.select("doc_id", "word_no", "seg"), ["doc_id", "word_no"])
    last = F.coalesce("end_page", "page")
    parts = segs.withColumn("_p", F.explode(F.sequence("page", last)))
    top = F.when(F.col("_p") == F.col("page"), F.col("y0") - 4).otherwise(F.lit(float("-inf")))
    bottom = F.when(F.col("_p") == F.col("end_page"), F.col("end_y")).otherwise(F.lit(float("inf")))
    rect = F.struct("seg", "number", top.alias("top"), bottom.alias("bottom"))
    return parts.groupBy("doc_id", F.col("_p").alias("page")).agg(F.collect_list(rect).alias("rects"))


def segment_text(words: DataFrame, anchors: DataFrame) -> DataFrame:
    """The words of each item's region, in reading order.

    Words of one height on a page lie in the same regions, so they become one line first, partly before anything is
    shuffled; a line without foreign words between its own goes on as one string. The regions of a page ride along with its
    lines (an equi-join on the page), so there is no range join. Lines become one string per item and page, by a grouping
    that the join's partitioning by page already serves; only these few strings meet per item, so no task holds the words
    of more than a page at a time.
    """
    rects = materialize(regions(materialize(anchors, "anchors")), "regions")

    def joined(parts):
        texts = F.array_compact(parts["text"])
        return F.when(F.size(texts) > 0, F.array_join(texts, " ")).alias("text")

    ws = F.col("ws")
    start = ws[0]["at"]
    lines = words.groupBy("doc_id", "page", "y0").agg(
        F.sort_array(F.collect_list(F.struct(F.col("word_no").alias("at"), "text"))).alias("ws")
    )
    gapless = F.element_at(ws, -1)["at"] - start + 1 == F.size(ws)
    lines = lines.withColumn("ws", F.when(gapless, F.array(F.struct(start.alias("at"), joined(ws)))).otherwise(ws))
    y = F.col("y0")
    hit = F.filter("rects", lambda r: (y >= r["top"]) & (y < r["bottom"]))
    inside = lines.join(rects, ["doc_id", "page"]).select("doc_id", "page", "ws", F.explode_outer(hit).alias("r")).filter("r is not null")
    item = ["doc_id", F.col("r.seg").alias("seg"), F.col("r.number").alias("number")]
    on_page = inside.groupBy("page", *item).agg(F.sort_array(F.flatten(F.collect_list("ws"))).alias("ws"))
    on_page = on_page.select("doc_id", "seg", "number", start.alias("at"), joined(ws))
    return on_page.groupBy("doc_id", "seg", "number").agg(joined(F.sort_array(F.collect_list(F.struct("at", "text")))))


def sequence_gaps(anchors: DataFrame) -> DataFrame:
    """Per document: anchors found, whether they run 1..n, missing ranges, numbers found more than once."""
    per = anchors.groupBy("doc_id", "number").agg(F.count("*").alias("c"))
    w = W.partitionBy("doc_id").orderBy("number")  # one row per item number of a document
    per = per.withColumn("_p", F.lag("number").over(w))
    gap = F.when(F.col("number") - F.col("_p") > 1, F.struct((F.col("_p") + 1).alias("a"), (F.col("number") - 1).alias("b")))
    g = per.withColumn("_gap", gap).groupBy("doc_id").agg(
        F.sum("c").alias("n"),
        F.min("number").alias("first"),
        F.max("number").alias("last"),
        F.sum(F.coalesce(F.col("_gap.b") - F.col("_gap.a") + 1, F.lit(0))).alias("missing"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list("_gap")), lambda s: F.concat_ws("-", s["a"], s["b"])), ","
        ).alias("missing_ranges"),
        F.count_if(F.col("c") > 1).alias("dupes"),
    )
    seq = slices.neighbours(anchors, ["doc_id"], "page", ["y0", "word_no"], lag={"_before": "number"})
    ok = seq.groupBy("doc_id").agg((F.count_if(F.col("number") != F.coalesce("_before", F.lit(0)) + 1) == 0).alias("sequence_ok"))
    return g.join(ok, "doc_id")
