"""Packing token streams into windows by order-preserving dynamic programming.

The documents of a task form one stream of tokens in stored order, which is cut into windows of at most `window` tokens.
A window that is not full is padded, but for lengths that are powers of two, which need none. Cuts lie at ends of
documents (free), at ends of sentences (a small penalty for the truncated document) or, where there is no sentence end
for `longest` tokens, at every `stride` tokens (a larger one). The cheapest cuts are found by dynamic programming over
these places: the best last cut before a place is the least of (cost - place) over the places one window back, which a
monotone queue keeps at hand, or lies a power of two back.

A task solves about `segment` tokens at a time; all windows but the last few are then settled and what follows the last
settled cut opens the next segment, so memory is bounded by the segment and one document, and the only window that is cut
short for want of tokens is a task's last.

Tokens come from a byte-level BPE vocabulary file of the `tokenizers` library, encoded by the faster `tiktoken` with the
same merges; tests hold them against each other.

Defined cases: a null text is empty; a document is its tokens and the end token, so an empty one is one token; rows are
documents of their own, whatever their id; an empty table gives no piece.
"""

from __future__ import annotations

import json
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Penalties, in tokens of padding, for cutting a document at a sentence end and elsewhere.
AT_SENTENCE, INSIDE = 16, 64
#: Texts are encoded in pieces of about so many characters, cut where no token can lie across.
PIECE = 1 << 20
CUT = re.compile(r"(?<=\S) (?=[A-Za-z])")
#: Columns of a piece after the keys.
COLUMNS = {"start": "long", "length": "long", "ids": "binary", "doc_tokens": "long", "sequence_id": "long", "offset": "long"}


# ---- tokens --------------------------------------------------------------------------------------------------------


def byte_characters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, others follow from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary file, ready to encode. Loaded once per task."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        stands = byte_characters()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        raw = {i: bytes(stands[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in special}
        self.encoding = tiktoken.Encoding(
            "packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in raw.items()}, special_tokens=special
        )
        size = max([*raw, *special.values()]) + 1
        # tokens that end a sentence if white space follows, that begin with white space, and that end one anyhow
        self.stops, self.opens, self.breaks = (np.zeros(size, bool) for _ in range(3))
        for i, b in raw.items():
            self.stops[i] = b.rstrip(b"\"')]").endswith((b".", b"!", b"?"))
            self.opens[i] = b[:1] in (b" ", b"\n", b"\t", b"\r")
            self.breaks[i] = b.endswith("。".encode()) or b"\n" in b

    def ids(self, text: str) -> np.ndarray:
        parts, start = [], 0
        while start < len(text):
            cut = CUT.search(text, start + PIECE) if len(text) - start > 2 * PIECE else None
            stop = cut.start() if cut else len(text)
            parts.append(np.asarray(self.encoding.encode_to_numpy(text[start:stop], allowed_special="all"), np.uint32))
            start = stop
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def places(self, ids: np.ndarray, longest: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
        """Where a document (with its end token) may be cut: places after its start, the last its end, and penalties."""
        here, after = ids[:-2], ids[1:-1]
        at = np.append(np.flatnonzero(self.stops[here] & self.opens[after] | self.breaks[here]) + 1, len(ids))
        cost = np.full(len(at), AT_SENTENCE, np.int64)
        gaps = np.diff(at, prepend=0)
        if (gaps > longest).any():
            more = [np.arange(a - g + stride, a, stride) for a, g in zip(at, gaps, strict=True) if g > longest]
            more = np.concatenate(more)
            at, cost = np.append(at, more), np.append(cost, np.full(len(more), INSIDE, np.int64))
            order = np.argsort(at, kind="stable")
            at, cost = at[order], cost[order]
        cost[-1] = 0
        return at, cost


# ---- the cuts ------------------------------------------------------------------------------------------------------


def padding(length: int, window: int) -> int:
    return 0 if length & (length - 1) == 0 else window - length


def best_cuts(at: np.ndarray, penalty: np.ndarray, window: int) -> list[int]:
    """Indices into `at` of the cheapest cuts from 0 to the last place; all gaps are at most `window`.

    cost(j) = penalty(j) + min over i of cost(i) + padding(at(j) - at(i)). Without the powers of two the minimum is that of
    cost(i) - (window - at(i)), up to terms of j: candidates that a later one beats leave the queue.
    """
    pos = np.append(0, at).astype(np.int64)
    n = len(pos)
    # pairs (i, j) of places a power of two apart
    where = np.full(int(pos[-1]) + 1, -1, np.int64)
    where[pos] = np.arange(n)
    exact: list[list[int]] = [[] for _ in range(n)]
    step = 1
    while step <= window:
        back = pos - step
        i = np.where(back >= 0, where[np.maximum(back, 0)], -1)
        for j in np.flatnonzero(i >= 0).tolist():
            exact[j].append(int(i[j]))
        step *= 2
    p, pen = pos.tolist(), [0, *penalty.tolist()]
    cost, came = [0] * n, [0] * n
    queue = deque([(0, 0)])  # (cost(i) + at(i), i), rising in both
    for j in range(1, n):
        low = p[j] - window
        while p[queue[0][1]] < low:
            queue.popleft()
        value, i = queue[0]
        best = value + window - p[j]
        for k in exact[j]:
            if cost[k] < best:
                best, i = cost[k], k
        best += pen[j]
        cost[j], came[j] = best, i
        here = best + p[j]
        while queue and queue[-1][0] >= here:
            queue.pop()
        queue.append((here, j))
    out, j = [], n - 1
    while j:
        out.append(j - 1)
        j = came[j]
    return out[::-1]


class Packer:
    """Packs one task's documents. Yields (row number, start, ids, document's tokens, window number, offset)."""

    def __init__(self, window: int, segment: int, settle: int = 4):
        self.window, self.segment, self.settle = window, segment, settle
        self.docs: deque = deque()  # (row, tokens used, ids, places, penalties)
        self.held, self.done = 0, 0

    def add(self, row, ids: np.ndarray, at: np.ndarray, penalty: np.ndarray):
        self.docs.append((row, 0, ids, at, penalty))
        self.held += len(ids)
        while self.held >= self.segment + self.window:
            yield from self.solve(False)

    def finish(self):
        if self.docs:
            yield from self.solve(True)

    def solve(self, last: bool):
        """Cut what is held, up to about a segment; settle all windows but the last few, if more tokens may come."""
        ats, pens, base = [], [], 0
        for _, used, _, at, penalty in self.docs:
            if base >= self.segment and not last:
                break
            first, stop = int(np.searchsorted(at, used, side="right")), len(at)
            if not last:  # of a long document its next part
                stop = max(first + 1, int(np.searchsorted(at, used + 2 * self.segment - base)))
            ats.append(at[first:stop] - used + base)
            pens.append(penalty[first:stop])
            base = int(ats[-1][-1])
            if stop < len(at):
                break
        at = np.concatenate(ats)
        cuts = [int(at[c]) for c in best_cuts(at, np.concatenate(pens), self.window)]
        if not last:
            cuts = cuts[: max(1, len(cuts) - self.settle)]
        start = 0
        for cut in cuts:
            yield from self.emit(cut - start)
            start = cut

    def emit(self, length: int):
        """The next `length` tokens as one window."""
        offset = 0
        while offset < length:
            row, used, ids, at, penalty = self.docs.popleft()
            n = min(length - offset, len(ids) - used)
            yield row, used, ids[used : used + n], len(ids), self.done, offset
            if used + n < len(ids):
                self.docs.appendleft((row, used + n, ids, at, penalty))
            offset += n
        self.held -= length
        self.done += 1


# ---- the operator --------------------------------------------------------------------------------------------------


def pack(
    df: DataFrame,
    keys: list[str],
    text: str,
    path: str,
    end: int = 1,
    window: int = 2048,
    longest: int = 256,
    stride: int = 16,
    segment: int = 1 << 18,
) -> DataFrame:
    """One row per piece: keys, start, length, ids (little-endian unsigned 32-bit, as binary), doc_tokens, sequence_id, offset.

    Map-only. Sequences are numbered inside a task and told apart by the task's number, so they agree when a task is
    repeated. `path` is read by the tasks; every worker needs the tokenizer's package.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(text).alias("_t"))
    size = len(keys)
    longest = max(1, min(longest, window // 2))  # else a window might end at no place at all
    stride = min(stride, longest)

    def run(it):
        part = TaskContext.get().partitionId() << 32
        packer, vocabulary = Packer(window, segment), Vocabulary(path)

        def batch_of(pieces):
            cols = [pa.array([p[0][k].as_py() for p in pieces], t) for k, t in enumerate(kinds)]
            cols += [
                pa.array([p[1] for p in pieces], pa.int64()),
                pa.array([len(p[2]) for p in pieces], pa.int64()),
                pa.array([p[2].astype("<u4").tobytes() for p in pieces], pa.binary()),
                pa.array([p[3] for p in pieces], pa.int64()),
                pa.array([part + p[4] for p in pieces], pa.int64()),
                pa.array([p[5] for p in pieces], pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(cols, [*names, *COLUMNS])

        kinds, out, held = [], [], 0
        for batch in it:
            kinds = kinds or [batch.schema.field(k).type for k in range(size)]
            for k in range(len(batch)):
                t = batch.column(size)[k].as_py()
                ids = np.append(vocabulary.ids(t or ""), np.uint32(end))
                for piece in packer.add([batch.column(c)[k] for c in range(size)], ids, *vocabulary.places(ids, longest, stride)):
                    out.append(piece)
                    held += len(piece[2])
                    if held > segment:
                        yield batch_of(out)
                        out, held = [], 0
        out += packer.finish()
        if out:
            yield batch_of(out)

    schema = ", ".join([f"{n} {rows.schema[n].dataType.simpleString()}" for n in names] + [f"{c} {t}" for c, t in COLUMNS.items()])
    got = rows.mapInArrow(run, schema)
    return got.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], *COLUMNS)


def report(df: DataFrame, keys: list[str], text: str, path: str, **options) -> DataFrame:
    """The pieces with the checksum of their ids in place of the ids."""
    got = pack(df, keys, text, path, **options)
    return got.select(
        *keys, "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
