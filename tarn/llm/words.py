"""Words of a unit of documents as NumPy arrays: 64-bit hashes, byte offsets and document bounds.

A word's hash is a polynomial over its bytes' random 64-bit values, taken from a
running sum modulo 2**64, so the cost is a few array passes over the bytes and
no Python object for a word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bytes hashed at once: small enough for a core's cache.
PIECE = 1 << 17
_U = np.uint64
_BASE = 0x9E3779B97F4A7C13  # odd, 3 modulo 8
_BYTES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, np.uint64) * _U(2) + _U(1)

_LOWER = np.arange(256)
_LOWER[65:91] += 32

#: Word bytes of the two word classes.
_SPACED = np.ones(256, bool)
_SPACED[[32, 9, 10, 11, 12, 13]] = False
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True

#: name -> (word bytes, value of each byte in the hash)
CLASSES = {
    "spaced": (_SPACED, _BYTES),
    "spaced_lower": (_SPACED, _BYTES[_LOWER]),
    "alnum_lower": (_ALNUM, _BYTES[_LOWER]),
}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _BASE & (2**64 - 1), np.uint64)
    down = np.full(n, pow(_BASE, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_POWERS = _powers(PIECE)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(29)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(32)
    return h


@dataclass
class Words:
    hash: np.ndarray  # uint64
    start: np.ndarray  # byte offsets in blob
    end: np.ndarray
    bounds: np.ndarray  # documents' first words; one more entry than documents
    blob: bytes

    @property
    def doc(self) -> np.ndarray:
        """Document of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def words_of(texts: list[bytes], kind: str) -> Words:
    """All words of all texts."""
    table, values = CLASSES[kind]
    blob = b" ".join(texts) + b" "
    hashes, starts, ends = [], [], []
    at, n = 0, len(blob)
    while at < n:
        to = min(at + PIECE, n)
        if to < n:
            cut = blob.rfind(b" ", at, to) + 1
            to = cut if cut > at else (blob.find(b" ", to) + 1 or n)
        a = np.frombuffer(blob, np.uint8, to - at, at)
        w = table[a]
        edge = np.flatnonzero(w[1:] != w[:-1]) + 1
        if w[0]:
            edge = np.concatenate(([0], edge))
        if len(edge) % 2:
            edge = np.concatenate((edge, [len(a)]))
        s, e = edge[0::2], edge[1::2]
        up, down = _POWERS if len(a) <= PIECE else _powers(len(a))
        total = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(values[a] * up[: len(a)], out=total[1:])
        hashes.append(mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)))
        starts.append(s + at)
        ends.append(e + at)
        at = to
    start = np.concatenate(starts)
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    return Words(np.concatenate(hashes), start, np.concatenate(ends), np.searchsorted(start, offsets), blob)


def hash_words(words: list[bytes], kind: str) -> np.ndarray:
    """Hashes of single words (none of which holds a break)."""
    return words_of(words, kind).hash if words else np.zeros(0, np.uint64)


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words: one for each word that n - 1 others follow in the array (bounds are the caller's)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out *= _U(_BASE & (2**64 - 1))
        out += h[k : len(h) - n + 1 + k]
    return mix(out)


class Vocabulary:
    """Word hash -> small id from 1; 0 for any other word. A bit table answers for most words that are not in it."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes)
        self.bits = max(16, int(len(self.sorted)).bit_length() + 4)
        self.table = np.zeros(1 << self.bits, bool)
        self.table[self._slot(self.sorted)] = True

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> _U(64 - self.bits)).astype(np.int64)

    def __len__(self) -> int:
        return len(self.sorted)

    def ids(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int32)
        maybe = np.flatnonzero(self.table[self._slot(h)])
        if len(maybe):
            x = h[maybe]
            k = np.searchsorted(self.sorted, x)
            k[k == len(self.sorted)] = 0
            out[maybe] = np.where(self.sorted[k] == x, k + 1, 0)
        return out


def runs(ids: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end of the maximal runs of non-zero ids inside a document, of ``least`` ids or more."""
    if not len(ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    on = ids > 0
    fresh = np.zeros(len(ids) + 1, bool)
    fresh[bounds] = True
    first = np.flatnonzero(on & (fresh[:-1] | ~np.concatenate(([False], on[:-1]))))
    end = np.flatnonzero(on & (fresh[1:] | ~np.concatenate((on[1:], [False])))) + 1
    keep = end - first >= least
    return first[keep], end[keep]
