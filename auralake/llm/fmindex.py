"""A compressed full-text index of integer sequences: suffix order by prefix doubling, and backward search over a wavelet matrix."""

from __future__ import annotations

import numpy as np


class RankBits:
    """A bit vector in 64-bit words with a running count for each word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(np.concatenate((bits, np.zeros(-n % 64 + 64, bool))), bitorder="little")
        self.words = packed.view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words))[:-1])).astype(np.int64)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low)


class WaveletMatrix:
    """Counts of a symbol before a position, one rank for each bit of the symbol."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits: list[RankBits] = []
        self.zeros: list[int] = []
        for level in reversed(range(self.levels)):
            bit = (symbols >> level & 1).astype(bool)
            self.bits.append(RankBits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate((symbols[~bit], symbols[bit]))
        self.first = self._walk(np.arange(sigma), np.zeros(sigma, np.int64))

    def _walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, bits in enumerate(self.bits):
            ones = bits.rank(i)
            i = np.where(c >> (self.levels - 1 - k) & 1, self.zeros[k] + ones, i - ones)
        return i

    def count(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._walk(c, i) - self.first[c]


def suffix_order(ranks: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes; equal values must end somewhere in unequal ones or at the end."""
    n, k = len(ranks), 1
    rank = np.unique(ranks, return_inverse=True)[1].astype(np.int64)
    while True:
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1 if k < n else 0
        order = np.argsort(key)  # equal keys share a rank, so their order does not matter
        sorted_key = key[order]
        fresh = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        k *= 2
        if not n or fresh[-1] == n - 1 or k >= 2 * n:
            return order


class FMIndex:
    """Index of several sequences of 64-bit values; a separator ends each, and no match reaches over one.

    It holds the alphabet, the wavelet matrix of the last column and a bit for each row whose sequence is `marked` (stands
    for several equal ones), but no text. Sequences are searched as codes of its alphabet (see `coded`).
    """

    def __init__(self, values: np.ndarray, sizes: np.ndarray, marked: np.ndarray | None = None):
        n, parts = len(values), len(sizes)
        self.alphabet, code = np.unique(values, return_inverse=True)
        start = np.cumsum(sizes + 1) - sizes - 1
        text = np.zeros(n + parts, np.int64)
        text[np.arange(n) + np.repeat(np.arange(parts), sizes)] = code + 1
        unequal = text + parts
        unequal[start + sizes] = np.arange(parts)  # separators differ for the order only
        order = suffix_order(unequal)
        self.length, self.sigma = len(text), len(self.alphabet) + 1
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=self.sigma))))
        self.bwt = WaveletMatrix(text[order - 1], self.sigma)
        self.marks = RankBits(np.repeat(marked, sizes + 1)[order]) if marked is not None and marked.any() else None

    def coded(self, values: np.ndarray) -> np.ndarray:
        """The codes of values; 0, the separator's, if the index has no such value."""
        at = np.minimum(np.searchsorted(self.alphabet, values), max(len(self.alphabet) - 1, 0))
        return np.where(self.alphabet[at] == values, at + 1, 0) if len(self.alphabet) else np.zeros(len(values), np.int64)

    def extend(self, low: np.ndarray, high: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix range of symbol c before the strings of a suffix range."""
        both = self.before[np.concatenate((c, c))] + self.bwt.count(np.concatenate((c, c)), np.concatenate((low, high)))
        return both[: len(c)], both[len(c) :]

    def often(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the strings of suffix ranges occur twice or more, marked sequences counted as several."""
        out = high - low >= 2
        return out if self.marks is None else out | (self.marks.rank(high) > self.marks.rank(low))

    def reach(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each range of a streamed text, the smallest place from `start` on from which the text up to `end` occurs twice or more."""
        at = end.copy()
        live = np.flatnonzero((at > start) & (self.length > 0))
        low, high = np.zeros(len(live), np.int64), np.full(len(live), self.length, np.int64)
        while len(live):
            c = codes[at[live] - 1]
            low, high = self.extend(low, high, c)
            on = self.often(low, high) & (c > 0)
            live, low, high = live[on], low[on], high[on]
            at[live] -= 1
            on = at[live] > start[live]
            live, low, high = live[on], low[on], high[on]
        return at


def matching_statistics(index: FMIndex, values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each value of the streamed sequences, the length of the longest run ending with it that occurs twice or more in the index."""
    codes, end = index.coded(values), np.arange(1, len(values) + 1)
    return end - index.reach(codes, np.repeat(np.cumsum(sizes) - sizes, sizes), end)


def repeated(values: np.ndarray, sizes: np.ndarray, window: int, marked: np.ndarray) -> list[tuple[int, int, int]]:
    """Intervals (sequence, start, end) of at least `window` values that occur twice or more in all sequences and together cover every such window; a marked sequence stands for several equal ones.

    The sequences are streamed past the index of all of them. A backward search from a window's end is a matching
    statistic cut at the window's length; a mismatch rules out all windows over it, and those are skipped. An index of the
    reversed sequences gives how far a repeat reaches to the right.
    """
    out: list[tuple[int, int, int]] = []
    part = np.flatnonzero(sizes >= window)
    if not len(part):
        return out
    index, mirror = FMIndex(values, sizes, marked), FMIndex(values[::-1], sizes[::-1], marked[::-1])
    codes = index.coded(values)
    start, n = np.cumsum(sizes) - sizes, len(values)
    base, size = start[part], sizes[part]
    t = np.zeros(len(part), np.int64)
    while len(part):
        s = index.reach(codes, base + t, base + t + window) - base
        hit = s == t
        if hit.any():
            # the place p of a text is n - p in its mirror image
            last = n - base[hit] - t[hit]
            end = t[hit] + last - mirror.reach(codes[::-1], n - base[hit] - size[hit], last)
            out += zip(part[hit].tolist(), t[hit].tolist(), end.tolist(), strict=True)
            s[hit] = end - window + 1
        t = s
        on = t + window <= size
        part, base, size, t = part[on], base[on], size[on], t[on]
    return out
