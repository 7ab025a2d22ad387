"""Benchmark decontamination with an FM-index per shard of training text.

Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. The phrases are the windows of
`window` words of the benchmark items, and whole items that are shorter. A task gathers the documents of its split up
to `shard_bytes` of text, writes them as symbols (a word of the benchmark, or an end), and indexes the stretches of
benchmark words that are long enough to hold the shortest phrase: no other word can be part of a match. All phrases
are searched backwards at once, their places are located from sampled suffix positions, and overlapping places merge
into spans. No document is shuffled.

Phrases reach the tasks in blocks of at most `block_bytes` of benchmark text; with more blocks the documents pass
through one index after the other and spans are united.

Defined cases: null or wordless text has no words and no hits; null or wordless items have no phrases; repeated items
and items with equal phrases all count by their id, each id once; a null id counts as "null"; a benchmark without
rows marks nothing; repeated documents are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import ALNUM, aside, chunks, share, shared
from .fmindex import FMIndex


def tokens(text: bytes | None) -> list[bytes]:
    return text.translate(ALNUM).split() if text else []


class Phrases:
    """Windows of a block of items as symbols, grouped by length, and the items of each."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int):
        self.vocab: dict[bytes, int] = {}
        self.ids = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(self.ids)}
        owners: dict[tuple, set[int]] = {}
        for i, text in items:
            ws = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in tokens(text)]
            for k in range(max(1, len(ws) - window + 1) if ws else 0):
                owners.setdefault(tuple(ws[k : k + window]), set()).add(number[i])
        self.groups = []  # (patterns, owners' starts, owners)
        for n in sorted({len(w) for w in owners}):
            mine = [w for w in owners if len(w) == n]
            starts = np.cumsum([0, *(len(owners[w]) for w in mine)])
            flat = np.array([x for w in mine for x in sorted(owners[w])], np.int64)
            self.groups.append((np.array(mine, np.int64).reshape(len(mine), n), starts, flat))
        self.shortest = min((len(w) for w in owners), default=0)


class Shard:
    """Documents of one shard, their words as symbols."""

    def __init__(self, phrases: Phrases):
        self.phrases, self.batches, self.sizes, self.parts, self.bytes = phrases, [], [], [], 0

    def add(self, batch: pa.RecordBatch, texts: list[bytes | None]) -> None:
        self.batches.append(batch)
        words: list[bytes] = []
        for t in texts:
            ws = tokens(t)
            self.sizes.append(len(ws))
            words += ws
            words.append(b"")  # ends the document
        self.parts.append(np.fromiter(map(self.phrases.vocab.get, words, repeat(0)), np.int32, len(words)))
        self.bytes += sum(len(t or b"") for t in texts)

    def matches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and phrase (group, row as one number list) of all occurrences, in words of the shard."""
        none = np.zeros(0, np.int64)
        symbols = np.concatenate(self.parts) if self.parts else np.zeros(0, np.int32)
        least = self.phrases.shortest
        if not least or not len(symbols):
            return none, none, []
        inside = symbols != 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
        start, stop = edge[::2], edge[1::2]
        long = stop - start >= least
        if not long.any():
            return none, none, []
        step = np.zeros(len(symbols) + 2, np.int32)
        step[start[long]] += 1
        step[stop[long] + 1] -= 1  # keeps the 0 behind the stretch
        place = np.flatnonzero(np.cumsum(step[:-1])[: len(symbols)] > 0)
        index = FMIndex(symbols[place])
        at, size, which = [], [], []
        for patterns, starts, owners in self.phrases.groups:
            lo, hi = index.search(patterns)
            n = hi - lo
            rows = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            at.append(place[index.locate(rows)])
            size.append(np.full(len(rows), patterns.shape[1]))
            which.append((np.repeat(np.arange(len(patterns)), n), starts, owners))
        return np.concatenate(at), np.concatenate(size), which

    def results(self) -> tuple[np.ndarray, list, list, list]:
        """Per document: words, span starts, span ends (words, merged) and item numbers."""
        sizes = np.array(self.sizes, np.int64)
        first = np.concatenate([[0], np.cumsum(sizes + 1)])
        at, size, which = self.matches()
        step = np.zeros(first[-1] + 1, np.int32)
        np.add.at(step, at, 1)
        np.add.at(step, at + size, -1)
        hit = np.cumsum(step) > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], hit])))
        spans = edge.reshape(-1, 2)
        doc = np.searchsorted(first, spans[:, 0], side="right") - 1
        lists = [[] for _ in sizes], [[] for _ in sizes], [set() for _ in sizes]
        for (a, b), d in zip(spans.tolist(), doc.tolist(), strict=True):
            lists[0][d].append(a - int(first[d]))
            lists[1][d].append(b - int(first[d]))
        done = 0
        for rows, starts, owners in which:
            d = np.searchsorted(first, at[done : done + len(rows)], side="right") - 1
            done += len(rows)
            if not len(rows):
                continue
            for x, r in np.unique(np.stack([d, rows], axis=1), axis=0).tolist():
                lists[2][x].update(owners[starts[r] : starts[r + 1]].tolist())
        return sizes, *lists


def unite(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Merge spans that overlap or touch."""
    starts, ends = [], []
    for x, y in sorted(zip(a, b, strict=True)):
        if ends and x <= ends[-1]:
            ends[-1] = max(ends[-1], y)
        else:
            starts.append(x)
            ends.append(y)
    return starts, ends


def scanner(model, shard_bytes: int):
    """Arrow batches with text, _from, _to and _items in; the same with the spans and items of this block added."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared(model)
        shard = Shard(phrases)

        def flush(shard):
            sizes, starts, ends, items = shard.results()
            k = 0
            for batch in shard.batches:
                cols = dict(zip(batch.schema.names, batch.columns, strict=True))
                n = batch.num_rows
                old = [cols[c].to_pylist() for c in ("_from", "_to", "_items")]
                out = [], [], []
                for j in range(n):
                    a, b = unite((old[0][j] or []) + starts[k + j], (old[1][j] or []) + ends[k + j])
                    ids = (old[2][j] or []) + [phrases.ids[x] for x in items[k + j]]
                    for o, v in zip(out, (a, b, sorted(set(ids))), strict=True):
                        o.append(v)
                cols["_words"] = pa.array(sizes[k : k + n], pa.int64())
                cols["_from"], cols["_to"] = (pa.array(x, pa.list_(pa.int32())) for x in out[:2])
                cols["_items"] = pa.array(out[2], pa.list_(pa.string()))
                k += n
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

        for batch, texts in chunks(it, "_text", 2 << 20):
            shard.add(batch, texts)
            if shard.bytes >= shard_bytes:
                yield from flush(shard)
                shard = Shard(phrases)
        yield from flush(shard)

    return run


def blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, bytes | None]]]:
    rows, size = [], 0
    for r in benchmark.select(F.col(item).cast("string"), F.col(text)).toLocalIterator():
        rows.append((r[0] if r[0] is not None else "null", r[1].encode() if r[1] is not None else None))
        size += len(rows[-1][1] or b"") + 64
        if size >= block_bytes:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def scan(
    docs: DataFrame,
    text: str,
    benchmark: DataFrame,
    item: str = "item_id",
    item_text: str = "text",
    keep: list[str] | None = None,
    window: int = 10,
    shard_bytes: int = 16 << 20,
    block_bytes: int = 4 << 20,
) -> DataFrame:
    """Add to the columns `keep` of `docs`: _words, _from and _to (word spans to remove) and _items (ids that occur)."""
    keep = docs.columns if keep is None else keep
    rows = docs.select(
        *keep,
        F.col(text).alias("_text"),
        F.lit(0).cast("long").alias("_words"),
        F.lit(None).cast("array<int>").alias("_from"),
        F.lit(None).cast("array<int>").alias("_to"),
        F.lit(None).cast("array<string>").alias("_items"),
    )
    fields = {f.name: f for f in rows.schema.fields}
    fields |= {
        "_words": StructField("_words", LongType()),
        "_from": StructField("_from", ArrayType(IntegerType())),
        "_to": StructField("_to", ArrayType(IntegerType())),
        "_items": StructField("_items", ArrayType(StringType())),
    }
    schema = StructType(list(fields.values()))
    got = False
    for block in blocks(benchmark, item, item_text, block_bytes):
        model = share(docs.sparkSession, Phrases(block, window))
        rows, got = rows.mapInArrow(scanner(model, shard_bytes), schema), True
    if not got:
        model = share(docs.sparkSession, Phrases([], window))
        rows = rows.mapInArrow(scanner(model, shard_bytes), schema)
    return rows.drop("_text")


def report(docs: DataFrame, keys: list[str], text: str, benchmark: DataFrame, **options) -> DataFrame:
    """Per document: keys, n_words, n_hit, n_items, items_sha256 and contaminated."""
    got = scan(docs, text, benchmark, keep=keys, **options)
    hit = F.aggregate(F.zip_with("_to", "_from", lambda b, a: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return got.select(
        *keys,
        F.col("_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("_from") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, text: str, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any hit, with their own columns."""
    plain, names, back = aside(docs)
    return back(scan(plain, names[text], benchmark, **options).where(F.size("_from") == 0))
