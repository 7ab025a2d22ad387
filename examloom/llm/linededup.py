"""Fuzzy line de-duplication over the whole corpus, with DataFrame operations only.

A line is normalised (lower-cased, anything but letters, digits and characters beyond ASCII to single blanks) and
summed up by a 64-bit SimHash of its words. Two different normalised lines are linked if their SimHashes differ in at
most `bits` places and their edit distance is at most (100 - percent) % of the longer one. Of every connected group of
lines one occurrence stays, the first by document id, row and line number; blank lines (nothing left after
normalising) all stay.

Equal lines become one row first. SimHashes are cut into bits + 2 blocks; two that differ in at most `bits` places
agree on at least two blocks, so lines meet under the key of each pair of blocks and of a band of lengths. Lines that meet
none under all their keys are dropped first. Lines whose lengths alone rule out a link are no pair. Under a key of at most `DIRECT` lines all meet. Under a larger one all meet
the key's leader (the line with the smallest number) first; only lines that this leaves outside the leader's component
meet the others, so no key writes all its pairs. Texts are fetched only for lines in a pair; each line is compared with
one partner first, then with those that this leaves in another component.

Defined cases: null text has no lines; empty text has one blank line; repeated rows are separate occurrences; ids that
are null come last; an empty table stays empty; line numbers start at 0.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize, scratch
from .common import KEY, aside, keyed
from .graph import components

#: Words are counted in 8-bit lanes of a long, so many at a time that none overflows.
LANE_WORDS = 127
LANES = 0x0101010101010101
#: Every other lane.
HALF_LANES = 0x0001000100010001
#: A list of so many line keys is sent to all tasks; a longer one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Under a key of so many lines all of them meet.
DIRECT = 64
#: What makes a line not blank.
SOLID = r"[0-9A-Za-z\x80-\x{10FFFF}]"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def folded(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+", " ")


def normal(line: Column) -> Column:
    return F.trim(folded(line))


def normal_lines(text: Column) -> Column:
    """The lines of a text, normalised but for blanks at their ends. The text is rewritten once, not line by line."""
    return lines_of(folded(text))


def occurrences(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One row per line with words: keep, at, norm, words, len, h1, h2 (two hashes that stand for the normalised line).

    The line's columns are made inside the array that is exploded: columns computed behind it would be computed again
    for every word of the line.
    """

    def parts(line: Column) -> Column:
        norm = F.trim(line)
        return F.struct(
            norm.alias("norm"), F.split(norm, " ").alias("words"), F.length(norm).alias("len"),
            F.xxhash64(norm).alias("h1"), F.xxhash64(F.lit("second"), norm).alias("h2"),
        )

    # outer, as the optimizer would otherwise rewrite the text once more for a filter of its own
    rows = docs.select(*keep, F.posexplode_outer(F.transform(normal_lines(F.col(text)), parts)).alias("at", "line"))
    return rows.select(*keep, "at", "line.*").where("norm != ''")


def lanes(parts: Column, i: int) -> Column:
    """Of each part of at most LANE_WORDS hashes: how many have bit 8 j + i, in lane j of a long."""
    count = lambda n, h: n + F.shiftrightunsigned(h, i).bitwiseAND(F.lit(LANES))
    return F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("long"), count))


def either(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def majority(counts: list[Column], n: Column) -> Column:
    """The 64-bit hash whose bit 8 j + i is 1 if more than half of n words have it; lane j of counts[i] counts them.

    n is at most LANE_WORDS. Adding LANE_WORDS - floor(n / 2) to a count sets its bit 7 where it is more than half. Every
    other lane is added to at a time, so that the top one doesn't reach the sign.
    """
    more = (F.lit(LANE_WORDS) - F.floor(n / 2)) * F.lit(HALF_LANES)
    over = lambda c: F.shiftrightunsigned(c.bitwiseAND(F.lit(255 * HALF_LANES)) + more, 7).bitwiseAND(F.lit(HALF_LANES))
    return either([F.shiftleft(over(F.shiftrightunsigned(c, 8 * odd)), i + 8 * odd) for i, c in enumerate(counts) for odd in (0, 1)])


def long_majority(counts: list[Column], n: Column) -> Column:
    """The same for any n; counts[i] is an array, of a long for each LANE_WORDS words."""
    one = lambda c, j: F.aggregate(
        c, F.lit(0).cast("long"), lambda s, x: s + F.shiftrightunsigned(x, 8 * j).bitwiseAND(F.lit(255))
    )
    bit = lambda c, i, j: F.when(one(c, j) * 2 > n, F.shiftleft(F.lit(1).cast("long"), 8 * j + i)).otherwise(F.lit(0).cast("long"))
    return either([bit(c, i, j) for i, c in enumerate(counts) for j in range(8)])


def simhashes(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """keep, at, h1, h2, len and sim per line. Words are counted inside their line's row, 8 counters to a long."""
    by = [*keep, "at", "h1", "h2", "len"]
    rows = occurrences(docs, text, keep)
    rows = rows.select(*by, F.transform("words", lambda w: F.xxhash64(F.lit("word"), w)).alias("_h"))
    starts = F.sequence(F.lit(1), F.size("_h"), F.lit(LANE_WORDS))
    parts = F.when(F.size("_h") <= LANE_WORDS, F.array("_h")).otherwise(F.transform(starts, lambda k: F.slice("_h", k, LANE_WORDS)))
    rows = rows.select(*by, F.size("_h").alias("_all"), parts.alias("_parts"))
    names = [f"_s{i}" for i in range(8)]
    rows = rows.select(*by, "_all", *(lanes(F.col("_parts"), i).alias(c) for i, c in enumerate(names)))
    sim = F.when(F.col("_all") <= LANE_WORDS, majority([F.col(c)[0] for c in names], F.col("_all")))
    return rows.select(*by, sim.otherwise(long_majority([F.col(c) for c in names], F.col("_all"))).alias("sim"))


def bands(length: Column, percent: int) -> Column:
    """Array of one or two bands of lengths; two lengths whose smaller is at least `percent` % of the larger share one."""
    if percent < 50:
        return F.array(F.lit(0))
    step = max(4 * math.log(100 / percent), 0.1)
    band = lambda x: F.floor(x / step).cast("int")
    log = F.log(F.greatest(length, F.lit(1)))
    return F.array_distinct(F.array(band(log), band(log - (math.log(100 / percent) + 1e-9))))


def block_keys(sim: Column, bits: int, band: Column) -> Column:
    """Array of keys: one per pair of blocks."""
    n = bits + 2
    edges = [64 * k // n for k in range(n + 1)]
    part = [F.shiftrightunsigned(sim, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:], strict=False)]
    pairs = combinations(range(n), 2)
    return F.array(*(F.xxhash64(F.lit(k), part[a], part[b], band) for k, (a, b) in enumerate(pairs)))


def near(bits: int, percent: int, sim: str, length: str) -> Column:
    """Whether a line and the one of `sim` and `length` could link, as far as SimHashes and lengths tell."""
    differ = F.bit_count(F.col("sim").bitwiseXOR(F.col(sim)))
    longer = F.greatest("len", length)
    return (differ <= bits) & (longer - F.least("len", length) <= F.floor(longer * (100 - percent) / 100))


def within(most: Column, chunk: int) -> Column:
    """Whether the edit distance of x and y is at most `most`.

    Two cheap bounds come first, since the distance itself costs the square of a line's length. Above: words replaced in
    place. Below: every edit spoils at most one of the disjoint chunks of x, and a chunk that is left whole is in y.
    """
    words = F.split("x", " "), F.split("y", " ")
    changed = F.zip_with(*words, lambda u, v: F.when(u == v, 0).otherwise(F.greatest(F.length(u), F.length(v))))
    replaced = F.aggregate(changed, F.lit(0), lambda n, c: n + c)
    spoilt = F.size(F.filter(F.regexp_extract_all("x", F.lit(f"(?s).{{{chunk}}}"), F.lit(0)), lambda c: ~F.col("y").contains(c)))
    return (
        F.when((F.size(words[0]) == F.size(words[1])) & (replaced <= most), True)
        .when(spoilt > most, False)
        .otherwise(F.call_function("levenshtein", "x", "y", most) >= 0)  # -1 beyond the bound
    )


def alike(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of line numbers whose texts are near enough."""
    left = texts.select(F.col("lid").alias("a"), F.col("norm").alias("x"))
    right = texts.select(F.col("lid").alias("b"), F.col("norm").alias("y"))
    most = F.floor(F.greatest(F.length("x"), F.length("y")) * (100 - percent) / 100).cast("int")
    both = pairs.join(left, "a").join(right, "b")
    return both.where(within(most, max(1, 70 // max(1, 100 - percent)))).select("a", "b")


def ordered(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def with_comp(rows: DataFrame, comp: DataFrame) -> DataFrame:
    named = comp.select(F.col("node").alias("lid"), "root")
    return rows.join(named, "lid", "left").withColumn("comp", F.coalesce("root", "lid")).drop("root")


def apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs whose lines are in different components."""
    for c in ("a", "b"):
        named = comp.select(F.col("node").alias(c), F.col("root").alias(f"_{c}"))
        pairs = pairs.join(named, c, "left").withColumn(f"_{c}", F.coalesce(f"_{c}", c))
    return pairs.where("_a != _b").select("a", "b")


def across(rows: DataFrame, main: DataFrame, bits: int, percent: int) -> DataFrame:
    """Pairs of near lines under a key that are in different components. main: the component that a key's rows need
    not be compared from, since all others are compared with it."""
    outside = rows.join(main, "key").where("comp != main")
    outside = outside.select("key", F.col("lid").alias("u"), F.col("sim").alias("su"), F.col("len").alias("lu"), F.col("comp").alias("cu"))
    pairs = outside.join(rows, "key").where((F.col("cu") != F.col("comp")) & near(bits, percent, "su", "lu"))
    return ordered(pairs, "u", "lid")


def keys_of(lines: DataFrame, bits: int, percent: int) -> DataFrame:
    """lid, sim, len and key, per key of a line."""
    sure = [F.coalesce(c, F.lit(0)).alias(c) for c in ("lid", "sim", "len")]  # never null, or each reader would filter
    rows = lines.select(*sure, F.explode(bands(F.col("len"), percent)).alias("band"))
    return rows.select("lid", "sim", "len", F.explode(block_keys(F.col("sim"), bits, F.col("band"))).alias("key"))


def may_link(bits: int, percent: int) -> Column:
    """Whether lines under a key may link: more than two (m), or two whose SimHashes (differ) and lengths are near."""
    near_lengths = F.col("high") - F.col("low") <= F.floor(F.col("high") * (100 - percent) / 100)
    return (F.col("m") > 2) | (F.col("m") == 2) & (F.bit_count("differ") <= bits) & near_lengths


def meeting(lines: DataFrame, bits: int, percent: int) -> DataFrame:
    """The lines (lid, sim, len) that may link with another under one of their keys. Most lines meet none, so all keys
    are sorted once here, and only those of the lines that are left are counted and joined."""
    under = W.partitionBy("key")
    rows = keys_of(lines, bits, percent).select(
        "*", F.count("*").over(under).alias("m"), F.min("len").over(under).alias("low"), F.max("len").over(under).alias("high"),
        F.bit_or("sim").over(under).bitwiseXOR(F.bit_and("sim").over(under)).alias("differ"),
    )
    return rows.where(may_link(bits, percent)).select("lid", "sim", "len").distinct()


def met(lines: DataFrame, bits: int, percent: int) -> DataFrame:
    """What lines meet under their keys: pairs (no key; a, b) of near lines under keys of at most DIRECT lines, and the
    lines (key, a, sim, len) of larger keys with the key's leader as b.

    All come from one shuffle of the lines by key, which Spark reuses while its readers ask for the same columns.
    """
    rows = keys_of(lines, bits, percent).repartition("key")
    shared = rows.groupBy("key").agg(
        F.count("*").alias("m"), F.min("lid").alias("lead"), F.max("lid").alias("last"), F.min("len").alias("low"),
        F.max("len").alias("high"), F.bit_or("sim").bitwiseXOR(F.bit_and("sim")).alias("differ"),
    )
    shared = shared.where(may_link(bits, percent)).select("key", "m", "lead", "last")
    few = rows.join(shared.where(F.col("m") <= DIRECT).select("key", "last"), "key").where("lid < last")
    few = few.select("key", F.col("lid").alias("u"), F.col("sim").alias("su"), F.col("len").alias("lu"))
    pairs = few.join(rows, "key").where((F.col("u") < F.col("lid")) & near(bits, percent, "su", "lu"))
    none = [F.lit(None).cast(kind).alias(c) for c, kind in (("key", "long"), ("sim", "long"), ("len", "int"))]
    pairs = pairs.select("u", "lid").distinct().select(none[0], F.col("u").alias("a"), F.col("lid").alias("b"), *none[1:])
    many = rows.join(shared.where(F.col("m") > DIRECT).select("key", "lead"), "key")
    return pairs.unionByName(many.select("key", F.col("lid").alias("a"), F.col("lead").alias("b"), "sim", "len"))


def groups(docs: DataFrame, doc_id: str, text: str, percent: int, bits: int) -> DataFrame:
    """Every different line: lid, root (its group) and first (place of its first occurrence)."""
    seen = simhashes(docs.select(doc_id, *KEY, text), text, [doc_id, *KEY])
    place = F.struct(F.col(doc_id).isNull().alias("z"), F.col(doc_id).alias("id"), *KEY, "at")
    lines = seen.groupBy("h1", "h2").agg(F.min("sim").alias("sim"), F.min("len").alias("len"), F.min(place).alias("first"))
    lines = materialize(lines.drop("h1", "h2").withColumn("lid", F.monotonically_increasing_id()), "different")

    found = materialize(met(materialize(meeting(lines, bits, percent), "meeting"), bits, percent), "met")
    pairs = found.where("key is null").select("a", "b")
    many = found.where("key is not null").select("key", F.col("a").alias("lid"), F.col("b").alias("lead"), "sim", "len")
    crowded = not many.isEmpty()
    if crowded:
        lead = many.where("lid = lead").select("key", F.col("sim").alias("lead_sim"), F.col("len").alias("lead_len"))
        star = many.join(lead, "key").where((F.col("lid") != F.col("lead")) & near(bits, percent, "lead_sim", "lead_len"))
        star = materialize(ordered(star, "lid", "lead"), "star")
        # lines that may link but not with a leader
        here = materialize(with_comp(many, components(star, "a", "b")), "here")
        main = here.where("lid = lead").select("key", F.col("comp").alias("main"))
        pairs = pairs.unionByName(star).unionByName(across(here, main, bits, percent))
        pairs = materialize(pairs.distinct(), "pairs")

    # texts of the lines in any pair, each from its first occurrence
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("lid")).distinct()
    wanted = materialize(lines.join(wanted, "lid").select("lid", *(f"first.{c}" for c in (*KEY, "at"))), "wanted")
    brief = wanted.count() <= BROADCAST_ROWS
    texts = docs.select(*KEY, F.posexplode(lines_of(F.col(text))).alias("at", "line"))
    texts = texts.join(F.broadcast(wanted) if brief else wanted, [*KEY, "at"])
    texts = materialize(texts.select("lid", normal(F.col("line")).alias("norm")), "texts")

    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = materialize(alike(first, texts, percent), "links")
    rest = apart(pairs.join(first, ["a", "b"], "left_anti"), components(links, "a", "b"))
    links = links.unionByName(materialize(alike(rest, texts, percent), "links"))
    comp = components(links, "a", "b")
    if crowded:
        # pairs that the leaders' components hid but whose texts did not link
        again = materialize(with_comp(many.join(wanted.select("lid"), "lid"), comp), "again")
        sizes = again.groupBy("key", "comp").agg(F.count("*").alias("c"))
        main = sizes.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("x"), F.count("*").alias("z")).where("z > 1")
        more = across(again, main.select("key", F.col("x.comp").alias("main")), bits, percent)
        more = materialize(alike(more.join(pairs, ["a", "b"], "left_anti"), texts, percent), "links")
        if not more.isEmpty():
            comp = components(links.unionByName(more), "a", "b")
    named = comp.select(F.col("node").alias("lid"), "root")
    return lines.join(named, "lid", "left").select("lid", F.coalesce("root", "lid").alias("root"), "first")


def decide(docs: DataFrame, doc_id: str, text: str, percent: int = 90, bits: int = 3) -> DataFrame:
    """Per row of `docs` (with row keys): doc_id, row key, n_lines, n_blank and kept (numbers of the lines that stay)."""
    with scratch(docs.sparkSession) as keep:
        stay = groups(docs, doc_id, text, percent, bits).groupBy("root").agg(F.min("first").alias("x"))
        stay = stay.groupBy(*(F.col(f"x.{c}").alias(c) for c in KEY)).agg(F.collect_list("x.at").alias("_stay"))
        stay = keep(stay, "stay")
    lines = lines_of(F.col(text))
    blank = F.transform(lines, lambda x, i: F.when(~x.rlike(SOLID), i))
    rows = docs.select(
        doc_id,
        *KEY,
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.filter(blank, lambda i: i.isNotNull()), F.array().cast("array<int>")).alias("_blank"),
    )
    rows = rows.withColumn("n_lines", F.when(F.col("n_lines") < 0, 0).otherwise(F.col("n_lines")))
    rows = rows.join(stay, KEY, "left")
    kept = F.array_sort(F.concat("_blank", F.coalesce("_stay", F.array().cast("array<int>"))))
    return rows.select(doc_id, *KEY, "n_lines", F.size("_blank").cast("long").alias("n_blank"), kept.alias("kept"))


def clean(docs: DataFrame, doc_id: str, text: str, **options) -> DataFrame:
    """The documents with only the lines that stay; a document that loses all its lines keeps an empty text."""
    plain, names, back = aside(docs)
    rows, doc_id, text = keyed(plain, "lines-input"), names[doc_id], names[text]
    kept = decide(rows, doc_id, text, **options).select(*KEY, F.col("kept").alias("_kept"))
    lines = lines_of(F.col(text))
    new = F.array_join(F.transform("_kept", lambda i: F.element_at(lines, i + 1)), "\n")
    return back(rows.join(kept, KEY).withColumn(text, F.when(F.col(text).isNotNull(), new)))


def report(docs: DataFrame, doc_id: str, text: str, **options) -> DataFrame:
    """Per document: doc_id, n_lines, n_blank, n_kept and kept_lines (comma-joined line numbers)."""
    got = decide(keyed(docs.select(doc_id, text), "lines-input"), doc_id, text, **options)
    return got.select(
        doc_id, "n_lines", "n_blank", F.size("kept").cast("long").alias("n_kept"),
        F.array_join(F.col("kept").cast("array<string>"), ",").alias("kept_lines"),
    )
