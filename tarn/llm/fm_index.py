"""FM-index of a sequence of small integers, in NumPy: suffix array by doubling,
Burrows-Wheeler transform in a wavelet matrix, suffix positions sampled.

The sequence is cut into segments; each ends with a terminator of its own, so no
match crosses a segment's end and the order of suffixes is total.
"""

from __future__ import annotations

import numpy as np

#: Every so many positions of the sequence the suffix array keeps its value.
SAMPLE = 8


def suffix_array(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffixes of ``text`` in order; ``ends`` are the terminators' positions, ordered as they stand and below every symbol."""
    n = len(text)
    rank = text.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    step = 1
    while True:
        key = rank * (int(rank.max()) + 2)
        key[: n - step] += rank[step:] + 1 if step < n else 0
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.concatenate(([0], np.cumsum(s[1:] != s[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        step *= 2


class WaveletMatrix:
    """Rank and access over an integer array, for many queries at once."""

    def __init__(self, a: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma).bit_length())
        self.zeros, self.ones = [], []
        for k in reversed(range(self.levels)):
            bit = (a >> k) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))))
            self.zeros.append(len(a) - int(self.ones[-1][-1]))
            a = np.concatenate((a[bit == 0], a[bit == 1]))

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c before position i."""
        lo, hi = np.zeros_like(i), i
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            one = (c >> (self.levels - 1 - level)) & 1 == 1
            a, b = ones[lo], ones[hi]
            lo = np.where(one, zeros + a, lo - a)
            hi = np.where(one, zeros + b, hi - b)
        return hi - lo

    def at(self, i: np.ndarray) -> np.ndarray:
        """The symbols at positions i."""
        out = np.zeros(len(i), np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            a = ones[i]
            one = ones[i + 1] > a
            out = out * 2 + one
            i = np.where(one, zeros + a, i - a)
        return out


class FMIndex:
    """Index of ``text`` (symbols from 1 to ``sigma``; 0 at the terminators, one of which is last)."""

    def __init__(self, text: np.ndarray, sigma: int):
        self.n = len(text)
        ends = np.flatnonzero(text == 0)
        order = suffix_array(text, ends)
        self.bwt = WaveletMatrix(text[order - 1].astype(np.int64), sigma)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma + 1))))
        keep = np.zeros(self.n, bool)
        keep[::SAMPLE] = True
        keep[(ends + 1) % self.n] = True  # a walk to the left ends where a segment begins
        kept = keep[order]
        self.kept = kept
        self.before = np.cumsum(kept) - kept
        self.samples = order[kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of the rows of ``patterns`` at once: bounds of their suffixes' interval."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for k in reversed(range(patterns.shape[1])):
            c = patterns[live, k].astype(np.int64)
            lo[live] = self.first[c] + self.bwt.rank(c, lo[live])
            hi[live] = self.first[c] + self.bwt.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
        hi = np.maximum(lo, hi)
        dead = np.ones(len(patterns), bool)
        dead[live] = False
        hi[dead] = lo[dead]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence of suffixes by their rows: to the left until a sampled one."""
        out = np.zeros(len(rows), np.int64)
        todo, row, steps = np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            there = self.kept[row]
            out[todo[there]] = self.samples[self.before[row[there]]] + steps
            todo, row = todo[~there], row[~there]
            if len(todo):
                c = self.bwt.at(row)
                row = self.first[c] + self.bwt.rank(c, row)
                steps += 1
        return out


def ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, value): every integer of every [lo, hi)."""
    n = hi - lo
    which = np.repeat(np.arange(len(lo)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
