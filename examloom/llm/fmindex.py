"""A full-text index of one shard of words: suffix order, Burrows-Wheeler text in a wavelet tree, sampled suffixes.

Symbols are integers: 0 ends a stretch of text, words are 1 and up. All searches run on arrays of patterns at once.
"""

from __future__ import annotations

import numpy as np


def suffix_order(t: np.ndarray) -> np.ndarray:
    """Sorted suffixes of `t`, which ends in 0. Every 0 differs from every other, by place.

    Prefix doubling: the first turn sorts several symbols packed into one number, each later turn doubles the length
    and sorts only suffixes that are not yet told apart.
    """
    n = len(t)
    ends = t == 0
    s = int(ends.sum())
    r = t.astype(np.int64) + (s - 1)
    r[ends] = np.arange(s)
    bits = int(r.max()).bit_length() or 1
    h = max(1, 62 // bits)
    key, wide = np.zeros(n, np.int64), np.concatenate([r, np.zeros(h, np.int64)])
    for k in range(h):
        key = (key << bits) | wide[k : k + n]
    sa = np.argsort(key)
    slots, rank = np.arange(n), np.zeros(n, np.int64)
    key = key[sa]
    while True:
        first = np.concatenate([[True], key[1:] != key[:-1]])
        heads = np.flatnonzero(first)
        rank[sa[slots]] = np.repeat(slots[heads], np.diff(np.append(heads, len(slots))))
        alone = first & np.append(first[1:], True)
        slots = slots[~alone]
        if not len(slots):
            return sa
        suf = sa[slots]
        key = (rank[suf] << 31) | rank[suf + h]
        order = np.argsort(key)
        sa[slots], key = suf[order], key[order]
        h *= 2


class Bits:
    """A bit array with constant-time ranks."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)[:-1]]).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)


class Wavelet:
    """A wavelet tree, stored level by level: zeros of a level come before its ones in the next."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        self.height = max(1, int(symbols.max(initial=0)).bit_length())
        self.levels, self.zeros = [], []
        for k in reversed(range(self.height)):
            bit = (symbols >> k) & 1
            self.levels.append(Bits(bit.astype(np.uint8)))
            self.zeros.append(int(self.n - bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol c stands before place i."""
        start = np.zeros_like(i)
        for k, bits, zeros in zip(reversed(range(self.height)), self.levels, self.zeros, strict=True):
            one = ((c >> k) & 1).astype(bool)
            a, b = bits.rank(start), bits.rank(i)
            start, i = np.where(one, zeros + a, start - a), np.where(one, zeros + b, i - b)
        return i - start

    def symbol_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and how often it stands before."""
        c, start = np.zeros_like(i), np.zeros_like(i)
        for bits, zeros in zip(self.levels, self.zeros, strict=True):
            one = bits.get(i)
            c = c * 2 + one
            a, b = bits.rank(start), bits.rank(i)
            start, i = np.where(one == 1, zeros + a, start - a), np.where(one == 1, zeros + b, i - b)
        return c, i - start


class FMIndex:
    def __init__(self, t: np.ndarray, rate: int = 8):
        """Index `t`, which ends in 0. Suffix positions are kept where they divide by `rate` or start a stretch."""
        t = np.asarray(t, np.int64)
        self.n = len(t)
        sa = suffix_order(t)
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(t))])
        self.tree = Wavelet(t[sa - 1])
        sampled = (sa % rate == 0) | (t[sa - 1] == 0)
        self.mark, self.samples = Bits(sampled.astype(np.uint8)), sa[sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of the suffixes that start with each pattern (one row of symbols each), from its end back."""
        known = patterns.max(axis=1, initial=0) < len(self.counts) - 1
        lo = np.zeros(len(patterns), np.int64)
        hi = np.where(known, self.n, 0)
        for k in reversed(range(patterns.shape[1])):
            live = np.flatnonzero(hi > lo)
            if not len(live):
                break
            c = patterns[live, k].astype(np.int64)
            base = self.counts[c]
            lo[live], hi[live] = base + self.tree.rank(c, lo[live]), base + self.tree.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row: walk back through the text to the next sampled one."""
        rows, out, steps = rows.astype(np.int64), np.zeros(len(rows), np.int64), 0
        left = np.arange(len(rows))
        while len(left):
            found = self.mark.get(rows) == 1
            out[left[found]] = self.samples[self.mark.rank(rows[found])] + steps
            left, rows = left[~found], rows[~found]
            c, r = self.tree.symbol_rank(rows)
            rows = self.counts[c] + r
            steps += 1
        return out
