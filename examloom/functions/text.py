"""Text folding, quality gate and rule scoring as native expressions."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import col

# Ligatures folded first, spacing marks dropped before decomposition.
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "œ": "oe", "æ": "ae"}
STRAY_MARKS = "´˜¸ˆ¨`ˇ˘˚˝"

# Quality gate.
MIN_CHARS = 50
MIN_ASCII_RATIO = 0.8
STOPWORD_MIN_CHARS = 250
MIN_STOPWORDS = 2
STOPWORDS = [
    "de", "da", "do", "que", "para", "com", "uma", "um", "os", "as", "em", "no", "na", "por", "sao", "seguir",
    "alternativa", "considere", "assinale", "seja", "abaixo", "correta", "apresenta",
]

# Scoring.
STRONG = 3
WEAK = 1
MAX_HITS = 3
MIN_SCORE = 3
SECONDARY_RATIO = 0.6
MAX_TOPICS = 3

_BLANKS = " \t\n\r\x0b\x0c"


def _candidates():
    """Code points that may unfold to ASCII or be combining: skips ideographs, syllables, surrogates, private use."""
    yield from range(0x80, 0x3400)
    yield from range(0xA000, 0xAC00)
    yield from range(0xF900, 0x11A00)
    yield from range(0x16AF0, 0x16B40)
    yield from range(0x1BC90, 0x20000)


@lru_cache(maxsize=None)
def fold_tables(strip_stray: bool) -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(from, to, multi): compatibility decomposition without combining marks, restricted to ASCII results.

    ``from``/``to`` feed ``translate`` (trailing ``from`` characters are deleted); ``multi`` lists
    the characters that unfold to several, with non-ASCII parts as spaces.
    """
    src, dst, gone, multi = [], [], [], []
    for cp in _candidates():
        c = chr(cp)
        if (strip_stray and c in STRAY_MARKS) or unicodedata.combining(c):
            gone.append(c)
            continue
        if strip_stray and c in LIGATURES:
            multi.append((c, LIGATURES[c]))
            continue
        folded = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if folded == c:
            continue
        if not folded:
            gone.append(c)
        elif any(x < "\x80" for x in folded):
            text = "".join(x if x < "\x80" else " " for x in folded) if strip_stray else folded
            if len(folded) == 1:
                src.append(c)
                dst.append(folded)
            else:
                multi.append((c, text))
    if strip_stray:
        gone.append("`")
    return "".join(src) + "".join(gone), "".join(dst), tuple(multi)


def _class(chars) -> str:
    """Character class with runs merged; only tried on non-ASCII characters."""
    cps = sorted(ord(c) for c in chars)
    parts, start, prev = [], cps[0], cps[0]
    for cp in cps[1:] + [None]:
        if cp is not None and cp == prev + 1:
            prev = cp
            continue
        parts.append(f"\\x{{{start:x}}}" if start == prev else f"\\x{{{start:x}}}-\\x{{{prev:x}}}")
        start = prev = cp
    return "(?=[^\\x00-\\x7f])[" + "".join(parts) + "]"


def fold(text, strip_stray: bool = False) -> Column:
    """Accent-free text. Plain ASCII passes through; rare multi-character folds run only where present."""
    text = col(text)
    src, dst, multi = fold_tables(strip_stray)
    # one literal, constant-folded to an array of (key, value)
    listing = "\x02".join(f"{a}\x01{b}" for a, b in multi)
    pairs = F.map_entries(F.str_to_map(F.lit(listing), F.lit("\x02"), F.lit("\x01")))
    expanded = F.when(
        F.rlike(text, F.lit(_class([a for a, _ in multi]))),
        F.aggregate(pairs, text, lambda acc, p: F.replace(acc, p["key"], p["value"])),
    ).otherwise(text)
    ascii_only = (F.octet_length(text) == F.length(text))
    if strip_stray:
        ascii_only = ascii_only & ~F.contains(text, F.lit("`"))
    return F.when(ascii_only, text).otherwise(F.translate(expanded, src, dst))


def normalize(text) -> Column:
    """Folded, lower-cased, everything but letters, digits and a little punctuation as single spaces (untrimmed)."""
    return F.regexp_replace(F.lower(fold(text, strip_stray=True)), r"[^a-z0-9()*+\-\\/.,;:_]+", " ")


def stripped(text) -> Column:
    return F.btrim(col(text), F.lit(_BLANKS))


def dense(strip) -> Column:
    """Folded lower-case text without white space."""
    return F.regexp_replace(F.lower(fold(strip)), r"\s", "")


def looks_usable(strip, dense_, norm) -> Column:
    """Whether extracted text is real prose, from its stripped, dense and normalised forms."""
    n = F.length(col(dense_))
    printable = F.length(F.regexp_replace(col(dense_), r"[^\x20-\x7e]", ""))
    stop = F.regexp_count(col(norm), F.lit(r"\b(?:" + "|".join(STOPWORDS) + r")\b"))
    return (
        F.when(F.length(col(strip)) < MIN_CHARS, False)
        .when(n == 0, False)
        .when(printable / n < MIN_ASCII_RATIO, False)
        .when(n < STOPWORD_MIN_CHARS, True)
        .otherwise(stop >= MIN_STOPWORDS)
    )


def spaced(norm) -> Column:
    """A normalised text's words, each between blanks of its own: word boundaries as plain text."""
    marks = "()*+-\\/.,;:"
    words = F.replace(F.translate(col(norm), marks, " " * len(marks)), F.lit(" "), F.lit("  "))
    return F.concat(F.lit(" "), words, F.lit(" "))


def _times(text: Column, literal: str) -> Column:
    """How often an ASCII literal stands in a text, by the bytes that go with it."""
    rest = F.octet_length(F.replace(text, F.lit(literal), F.lit("")))
    return ((F.octet_length(text) - rest) / len(literal)).cast("int")


def hits(norm: Column, pattern: str, words: Column | None = None) -> Column:
    """Number of matches, counted without a regex engine where the pattern is a plain literal.

    So are literals of word characters between word boundaries, in `words`, the `spaced` text, if it is given. Other
    patterns are tried only on texts that contain their longest mandatory literal.
    """
    bounded = re.fullmatch(r"(\\b)?([a-z0-9_]+)(\\b)?", pattern)
    if words is not None and bounded and (bounded[1] or bounded[3]):
        literal = " " * bool(bounded[1]) + bounded[2] + " " * bool(bounded[3])
        return F.when(F.contains(words, F.lit(literal)), _times(words, literal)).otherwise(F.lit(0))
    if re.fullmatch(r"[a-z0-9 /,;:_]+", pattern):
        return _times(norm, pattern)
    count = F.regexp_count(norm, F.lit(pattern))
    need = mandatory_literal(pattern)
    return F.when(F.contains(norm, F.lit(need)), count).otherwise(F.lit(0)) if need else count


def mandatory_literal(pattern: str) -> str:
    """Longest run of plain characters every match must contain ("" when unsure).

    Only characters outside all groups and classes count, and only those without a quantifier that allows none.
    """
    runs, run, depth, k = [], "", 0, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            runs, run, k = [*runs, run], "", k + 2
            continue
        if c == "[":  # to the end of the class; a bracket may be its first member
            end = pattern.find("]", k + 2 + (pattern[k + 1 : k + 2] == "^"))
            if end < 0:
                return ""
            runs, run, k = [*runs, run], "", end + 1
            continue
        depth += (c == "(") - (c == ")")
        if c == "|" and depth == 0:
            return ""
        if c in "?*{" and depth == 0:
            run = run[:-1]
        if depth == 0 and re.match(r"[a-z0-9 ]", c):
            run += c
        else:
            runs, run = [*runs, run], ""
            if c == "{":
                k = pattern.find("}", k)
                if k < 0:
                    return ""
        k += 1
    return max([*runs, run], key=len)


def topic_scores(norm, rules: list[tuple[str, str, int]], words=None) -> Column:
    """Array of (slug, score) with score > 0; a rule counts at most MAX_HITS times. A null text is empty.

    `words` is the `spaced` text, as a column of its own, since many rules read it.

    One projection over the text: no join with the rule table and no shuffle, whatever the number
    of documents. For rule tables of hundreds of rows see `classify.score_indexed`.
    """
    norm = F.coalesce(col(norm), F.lit(""))
    words = None if words is None else F.coalesce(col(words), F.lit(""))
    by_slug: dict[str, list[tuple[str, int]]] = {}
    for slug, pattern, weight in rules:
        by_slug.setdefault(slug, []).append((pattern, weight))
    scored = []
    for slug, items in by_slug.items():
        total = F.lit(0)
        for pattern, weight in items:
            total = total + F.least(hits(norm, pattern, words), F.lit(MAX_HITS)) * weight
        scored.append(F.struct(F.lit(slug).alias("slug"), total.cast("int").alias("score")))
    return F.filter(F.array(*scored), lambda s: s["score"] > 0)


def ranked(scores) -> Column:
    """Scores by (-score, slug)."""
    keyed = F.array_sort(F.transform(col(scores), lambda s: F.struct((-s["score"]).alias("k"), s["slug"].alias("slug"))))
    return F.transform(keyed, lambda s: F.struct(s["slug"].alias("slug"), (-s["k"]).alias("score")))


def pick_topics(rank) -> Column:
    """Topics of a ranked score array: none below MIN_SCORE, else the best and its close runners-up."""
    rank = col(rank)
    best = F.coalesce(F.try_element_at(rank, F.lit(1))["score"], F.lit(0))
    cutoff = F.greatest(F.lit(float(MIN_SCORE)), best * SECONDARY_RATIO)
    top = F.transform(F.filter(F.slice(rank, 1, MAX_TOPICS), lambda s: s["score"] >= cutoff), lambda s: s["slug"])
    return F.when(best >= MIN_SCORE, top).otherwise(F.array().cast("array<string>"))
