"""Removal of repeated passages, found by difference-cover anchors.

Any two positions of a passage have, at one and the same offset below the
period, positions that are both in the cover modulo the period. So it is enough
to hash short windows at cover positions: two occurrences of a passage of
``window`` words share the anchor at that offset. Anchors seen twice anywhere
are extended to every window around them, and of equal windows all but the
first are removed.

 1. Blocks send the hashes of their anchors (32 bits in a bucket: a false match
    only costs a comparison), buckets answer with a bit: seen more than once.
 2. Blocks extend those anchors to windows and send the 64-bit hash and the
    smallest document of each distinct window, buckets answer: yours is first.
 3. Blocks remove the words of all windows that are not first.

First is the smaller doc_id (null before any), then the earlier start; of rows
with the same doc_id the one in the earlier block. Null and empty texts have no
words. Texts of fewer words than a window keep all. Empty tables give no rows.
Extra columns are ignored. A very long text is worked on whole, in a block of its own.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
from pyspark.sql import DataFrame

from tarn.llm.blocks import answered, asked, bits_of, blocks, bucket_bits, filled, pieces, told
from tarn.llm.shared import Scratch
from tarn.llm.words import Words, shingles, words_of

#: The cover {0, 1, 3, 9} has every difference modulo 13.
PERIOD, COVER = 13, (0, 1, 3, 9)
KIND = "spaced"
NULL_FIRST = -(1 << 63)


def anchors(w: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of texts that have a window."""
    size = window - PERIOD + 1
    h = shingles(w.hash, size)
    n = w.counts()
    place = np.arange(len(w.hash)) - np.repeat(w.bounds[:-1], n)
    left = np.repeat(n, n) - place  # words from here to the document's end
    ok = np.isin(place % PERIOD, COVER) & (left >= size) & (np.repeat(n, n) >= window)
    at = np.flatnonzero(ok)
    return at, h[at]


def _keys(h: np.ndarray, bits: int) -> np.ndarray:
    """Hashes without the bits that are neither bucket nor among the 32 sent."""
    return h >> np.uint64(32 - bits) << np.uint64(32 - bits)


def _first_question(w: Words, window: int, bits: int):
    at, h = anchors(w, window)
    keys, inverse, n = np.unique(_keys(h, bits), return_inverse=True, return_counts=True)
    return at, keys, inverse, n


def _windows(w: Words, window: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows around the anchors ``at``."""
    n = w.counts()
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    doc = np.searchsorted(w.bounds, at, "right") - 1
    lo = np.maximum(at - PERIOD + 1, w.bounds[doc])
    hi = np.minimum(at, w.bounds[doc + 1] - window) + 1
    mark = np.zeros(len(w.hash) + 1, np.int32)
    np.add.at(mark, lo, 1)
    np.add.at(mark, hi, -1)
    start = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
    return start, shingles(w.hash, window)[start]


def _second_question(content: tuple, got: dict, window: int, bits: int):
    """Words; starts and the number of each one's distinct window; distinct windows' hashes and first start."""
    ids, texts = content
    w = words_of(texts, KIND)
    at, keys, inverse, _ = _first_question(w, window, bits)
    seen = filled(np.zeros(len(keys), bool), keys, bits, got.get(1, {}), bits_of)
    start, h = _windows(w, window, at[seen[inverse]] if len(at) else at)
    doc = np.searchsorted(w.bounds, start, "right") - 1
    number = np.array([NULL_FIRST if d is None else d for d in ids], np.int64)
    order = np.lexsort((start, number[doc], h))
    s = h[order]
    new = np.concatenate(([True], s[1:] != s[:-1])) if len(s) else np.zeros(0, bool)
    which = np.empty(len(s), np.int64)
    which[order] = np.cumsum(new) - 1
    first = order[new]
    return w, start, which, s[new], first, number[doc]


def repeated_passages(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the kept text's removed words as spans of word numbers (``spans``: int64 pairs)."""
    if window < PERIOD + 1:
        raise ValueError(f"a window has more than {PERIOD} words")
    scratch = Scratch(docs.sparkSession, "passages")
    table = blocks(docs, scratch)
    bits = bucket_bits(table)

    def send_anchors(content, got):
        _, keys, _, n = _first_question(words_of(content[1], KIND), window, bits)
        low = (keys >> np.uint64(32 - bits)).astype(np.uint32)
        for bucket, a, b in pieces(keys, bits):
            yield bucket, low[a:b].tobytes() + np.packbits(n[a:b] > 1).tobytes()

    def seen_twice(bucket, of, payloads):
        sizes = [(8 * len(p) + 32) // 33 for p in payloads]
        sizes = [k if 4 * k + (k + 7) // 8 == len(p) else k - 1 for k, p in zip(sizes, payloads)]
        keys = np.concatenate([np.frombuffer(p, np.uint32, k) for p, k in zip(payloads, sizes)])
        many = np.concatenate([np.unpackbits(np.frombuffer(p, np.uint8, offset=4 * k), count=k) for p, k in zip(payloads, sizes)]).astype(bool)
        order = np.argsort(keys, kind="stable")
        s = keys[order]
        same = s[1:] == s[:-1]
        twice = np.zeros(len(s), bool)
        twice[1:] |= same
        twice[:-1] |= same
        many[order] |= twice
        at = 0
        for block, k in zip(of, sizes):
            yield block, np.packbits(many[at : at + k]).tobytes()
            at += k

    def send_windows(content, got):
        _, _, _, h, first, number = _second_question(content, got, window, bits)
        for bucket, a, b in pieces(h, bits):
            doc = number[first[a:b]]
            base = int(doc.min())
            narrow = int(doc.max()) - base < 1 << 32
            rest = (doc - base).astype(np.uint32) if narrow else doc
            yield bucket, np.array([b - a, base, narrow], np.int64).tobytes() + h[a:b].tobytes() + rest.tobytes()

    def first_holder(bucket, of, payloads):
        hs, docs_, sizes = [], [], []
        for p in payloads:
            k, base, narrow = (int(x) for x in np.frombuffer(p, np.int64, 3))
            hs.append(np.frombuffer(p, np.uint64, k, 24))
            docs_.append(np.frombuffer(p, np.uint32, k, 24 + 8 * k).astype(np.int64) + base if narrow else np.frombuffer(p, np.int64, k, 24 + 8 * k))
            sizes.append(k)
        h, doc = np.concatenate(hs), np.concatenate(docs_)
        order = np.lexsort((doc, h))  # stable: blocks come in their order
        s = h[order]
        first = np.zeros(len(h), bool)
        first[order[np.concatenate(([True], s[1:] != s[:-1]))]] = True
        at = 0
        for block, k in zip(of, sizes):
            yield block, np.packbits(first[at : at + k]).tobytes()
            at += k

    def remove(content, got):
        w, start, which, h, first, _ = _second_question(content, got, window, bits)
        own = filled(np.zeros(len(h), bool), h, bits, got.get(2, {}), bits_of)
        stays = np.zeros(len(start), bool)
        stays[first] = own
        gone = start[~stays]
        mark = np.zeros(len(w.hash) + 1, np.int32)
        np.add.at(mark, gone, 1)
        np.add.at(mark, gone + window, -1)
        keep = np.cumsum(mark[:-1]) == 0
        n = w.counts()
        total = np.concatenate(([0], np.cumsum(~keep)))
        removed = total[w.bounds[1:]] - total[w.bounds[:-1]]
        shas, spans = [], []
        for d, text in enumerate(content[1]):
            parts, span = text.split(), b""
            if removed[d]:
                own_keep = keep[w.bounds[d] : w.bounds[d + 1]]
                parts = itertools.compress(parts, own_keep.tolist())
                span = np.flatnonzero(np.diff(np.concatenate(([True], own_keep, [True])))).astype(np.int64).tobytes()
            shas.append(hashlib.sha256(b" ".join(parts)).hexdigest())
            spans.append(span)
        return {"doc_id": content[0], "n_words": n, "n_removed": removed, "kept_sha256": shas, "spans": spans}

    once = scratch.table(answered(table, asked(table, send_anchors), seen_twice, kind=1), "seen", codec="none")
    firsts = scratch.table(answered(table, asked(table, send_windows, [once]), first_holder, kind=2), "first", codec="none")
    result = told(table, [once, firsts], "doc_id long, n_words long, n_removed long, kept_sha256 string, spans binary", remove)
    result = scratch.table(result, "result")
    scratch.drop("blocks", "seen", "first")
    return result
