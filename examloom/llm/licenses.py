"""License scans: winnowed fingerprints of templates pick candidates, banded alignment measures them.

Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. A fingerprint is the hash of `k` words;
of every `window` neighbouring hashes the least is kept, in templates and documents alike, so any shared run of
k + window - 1 words shares a fingerprint. The templates' fingerprints form an inverted index of (template, place).
A document's hits vote for diagonals (document place minus template place); neighbouring diagonals of a template are
one candidate. Along its band the longest common subsequence of words is found, which gives the matched words,
coverage (matched / template words) and the matched span. Matches with less than `least` coverage are dropped, and so
are those whose span lacks the template's naming words: the phrase that tells this license and version from others,
which must stand in the span word for word. Then of overlapping spans the one with more matched words stays.

A template is (license, text) or (license, text, naming words); without naming words coverage alone decides.

The templates are a parameter that the driver holds (at most `MOST_TEMPLATE_WORDS` words). Map-only; whole texts.

Defined cases: null or wordless text has no matches; a notice that occurs several times is reported each time; of
equal matches the earlier one, then the license first in order, stays; a template of fewer than k + window - 1 words
is found by any of its fingerprints; templates without words are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, share, shared
from .decontam import tokens
from .ngramjoin import Hashes, mix

MOST_TEMPLATE_WORDS = 5_000_000


def hashes_of(words: list[bytes], k: int, known: Hashes) -> np.ndarray:
    """The hash of each run of k words; of all words, where there are fewer."""
    a = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(k, len(words))
    with np.errstate(over="ignore"):
        h = mix(a[: len(a) - k + 1] + np.uint64(k)) if k else a
        for j in range(1, k):
            h = mix(h + a[j : j + len(h)])
    return h


def winnow(h: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash of every window, the last of equals."""
    if len(h) <= window:
        return np.array([len(h) - 1 - int(h[::-1].argmin())]) if len(h) else np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(h, window)[:, ::-1]
    return np.unique(np.arange(len(view)) + window - 1 - view.argmin(1))


def align(words: list[bytes], template: list[bytes], low: int, high: int) -> tuple[int, int, int]:
    """Matched words and span [start, stop) of a longest common subsequence on the diagonals low to high."""
    # best[j]: (matched, start, stop) of a way that ends before document place j
    best: dict[int, tuple[int, int, int]] = {}
    none = (0, 1 << 60, -1)
    top = none
    for i, t in enumerate(template):
        now: dict[int, tuple[int, int, int]] = {}
        left = none
        for j in range(max(0, i + low), min(len(words), i + high + 1)):
            # keys are document places + 1 of the previous row
            best_here = max(best.get(j + 1, none), left, key=lambda x: (x[0], x[1]))
            if words[j] == t:
                n, start, _ = best.get(j, none)
                got = (n + 1, j if n == 0 else start, j + 1)
                if got[0] > best_here[0] or (got[0] == best_here[0] and got[1] > best_here[1]):
                    best_here = got
            now[j + 1] = left = best_here
            if left[0] > top[0] or (left[0] == top[0] and left[2] - left[1] < top[2] - top[1]):
                top = left
        best = now
    return top


def holds(words: list[bytes], phrase: list[bytes]) -> bool:
    """Whether the phrase stands in the words, its words right behind one another."""
    n = len(phrase)
    return any(words[k : k + n] == phrase for k in range(len(words) - n + 1))


class Index:
    def __init__(self, templates: list[tuple[str, ...]], k: int, window: int):
        self.k, self.window = k, window
        known = Hashes()
        self.words = [tokens(t[1].encode()) for t in templates]
        self.names = [t[0] for t in templates]
        self.naming = [tokens("".join(t[2:]).encode()) for t in templates]
        if sum(map(len, self.words)) > MOST_TEMPLATE_WORDS:
            raise ValueError("the templates are too large to be held by every task")
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for n, ws in enumerate(self.words):
            h = hashes_of(ws, k, known)
            for p in winnow(h, window).tolist():
                self.places[int(h[p])].append((n, p))
            if len(h) <= window:  # short templates are found by any of their runs
                for p in range(len(h)):
                    if (n, p) not in self.places[int(h[p])]:
                        self.places[int(h[p])].append((n, p))
        self.prints = np.array(sorted(self.places), np.uint64)

    def candidates(self, h: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, lowest diagonal, highest diagonal) of the document's hits."""
        short = np.isin(h, self.prints)
        if not short.any():
            return []
        keep = np.zeros(len(h), bool)
        keep[winnow(h, self.window)] = True
        votes: dict[int, set[int]] = defaultdict(set)
        for p in np.flatnonzero(short).tolist():
            for n, q in self.places[int(h[p])]:
                if keep[p] or len(self.words[n]) < self.k + self.window:
                    votes[n].add(p - q)
        out = []
        for n, diagonals in votes.items():
            band = max(2, len(self.words[n]) // 8)
            run: list[int] = []
            for d in sorted(diagonals):
                if run and d - run[-1] > band:
                    out.append((n, run[0] - band, run[-1] + band))
                    run = []
                run.append(d)
            out.append((n, run[0] - band, run[-1] + band))
        return out

    def matches(self, words: list[bytes], h: np.ndarray, least: float) -> list[tuple[str, int, int, int, float]]:
        """(license, start, stop, matched words, coverage), by start."""
        found = []
        for n, low, high in self.candidates(h):
            template = self.words[n]
            matched, start, stop = align(words, template, low, high)
            coverage = matched / len(template)
            if matched and coverage >= least and holds(words[start:stop], self.naming[n]):
                found.append((self.names[n], start, stop, matched, coverage))
        found.sort(key=lambda x: (-x[3], -x[4], x[1], x[0]))
        kept: list[tuple] = []
        for x in found:
            if all(x[2] <= y[1] or x[1] >= y[2] for y in kept):
                kept.append(x)
        return sorted(kept, key=lambda x: (x[1], x[0]))


def scan(
    docs: DataFrame, text: str, templates: list[tuple[str, ...]], keep: list[str], k: int = 3, window: int = 2, least: float = 0.8
) -> DataFrame:
    """The columns `keep`, n_words and matches: array of (license, start, stop, matched, coverage), spans in words."""
    rows = docs.select(*keep, F.col(text).alias("_text"))
    handle = share(docs.sparkSession, Index([t for t in templates if tokens(t[1].encode())], k, window))
    kinds = dict(rows.dtypes)
    kind = pa.list_(
        pa.struct([("license", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("matched", pa.int64()), ("coverage", pa.float64())])
    )
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    schema += ", n_words long, matches array<struct<license: string, start: long, stop: long, matched: long, coverage: double>>"

    def run(it):
        index, known = shared(handle), Hashes()
        names = ["license", "start", "stop", "matched", "coverage"]
        for batch, texts in chunks(it, "_text", 2 << 20):
            sizes, out = [], []
            for t in texts:
                words = tokens(t)
                sizes.append(len(words))
                got = index.matches(words, hashes_of(words, k, known), least)
                out.append([dict(zip(names, m, strict=True)) for m in got])
            cols = [*(batch.column(c) for c in keep), pa.array(sizes, pa.int64()), pa.array(out, kind)]
            yield pa.RecordBatch.from_arrays(cols, [*keep, "n_words", "matches"])

    return rows.mapInArrow(run, schema)


def report(docs: DataFrame, keys: list[str], text: str, templates: list[tuple[str, ...]], **options) -> DataFrame:
    """Per document: keys, n_words, n_matches, licenses (in order, comma-joined), matched_words, coverage (the highest,
    0 without a match) and spans ("license:start-stop", in words, comma-joined)."""
    got = scan(docs, text, templates, keys, **options)
    m = F.col("matches")
    return got.select(
        *keys,
        "n_words",
        F.size(m).cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(m["license"])), ",").alias("licenses"),
        F.aggregate(m["matched"], F.lit(0).cast("long"), lambda s, x: s + x).alias("matched_words"),
        F.coalesce(F.array_max(m["coverage"]), F.lit(0.0)).alias("coverage"),
        F.array_join(
            F.transform(m, lambda x: F.concat(x["license"], F.lit(":"), x["start"].cast("string"), F.lit("-"), x["stop"].cast("string"))), ","
        ).alias("spans"),
    )
