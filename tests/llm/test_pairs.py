"""Operators that hold documents against each other, against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from tarn.llm import blocks, jaccard_join, substring_dedup


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def shingle_sets(rows):
    out = {}
    for d, t in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(t)]
        out[d] = frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def brute_components(rows):
    s = shingle_sets(rows)
    parent = {d: d for d in s}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(s), 2):
        k = len(s[a] & s[b])
        if s[a] and s[b] and 100 * k >= 75 * (len(s[a]) + len(s[b]) - k):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {d: (len(s[d]), find(d)) for d in s}


@pytest.mark.parametrize("small,total,pairs,block", [(64, 48, 1 << 21, 8 << 20), (4, 2, 50, 4000), (2, 1, 7, 4000)])
def test_components(docs, rows, monkeypatch, small, total, pairs, block):
    for k, v in {"SMALL": small, "TOTAL": total, "LEAST_CHUNK": 3, "MOST_CHUNK": 10, "CHUNKS": 2, "PAIRS": pairs}.items():
        monkeypatch.setattr(jaccard_join, k, v)
    monkeypatch.setattr(blocks, "BLOCK_BYTES", block)
    want = brute_components([(d, t) for d, t, *_ in rows])
    got = jaccard_join.jaccard_components(docs).collect()
    assert len(got) == len(rows)
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got)


def test_join_tells_only_what_it_verified(docs):
    """Not all links inside a component are tested, so no number of links is given."""
    assert jaccard_join.jaccard_components(docs).columns == ["doc_id", "n_shingles", "component_id"]


def test_signatures_meet_whatever_is_missing():
    join, rng = jaccard_join.Join(5, 75, 100), np.random.default_rng(4)
    for trial in range(300):
        n = int(rng.integers(2, 120))
        universe = np.unique(rng.integers(1, 1 << 63, 200, np.uint64))
        x = universe[rng.choice(len(universe), n, replace=False)]
        spare = np.setdiff1d(universe, x)
        gone = int(rng.integers(0, n // 4 + 1))
        y = np.concatenate((x[gone:], spare[: int(rng.integers(0, n // 3 + 1))]))
        x, y = np.sort(x), np.sort(y)
        k = len(np.intersect1d(x, y))
        if 100 * k < 75 * (len(x) + len(y) - k):
            continue
        frequent = np.sort(rng.choice(universe, int(rng.integers(0, len(universe))), replace=False))
        a, b = (join.signatures(s, jaccard_join.among(s, frequent)) for s in (x, y))
        assert len(np.intersect1d(a, b)), (trial, n)


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(100):
        a, b = (np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 300)), np.uint64)) for _ in range(2))
        b = np.unique(np.concatenate((b, a[: len(a) // 2])))
        for each in (1, 8):
            assert jaccard_join.difference(jaccard_join.parity(a, each), jaccard_join.parity(b, each)) <= len(np.setxor1d(a, b))


def test_components_of_paths(spark):
    from tarn.llm.components import components
    from tarn.llm.shared import Scratch

    edges = [(k, k + 1) for k in range(30)] + [(100, 101), (101, 105), (5, 1000)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "c").collect()}
    assert all(got[k] == 0 for k in [*range(31), 1000]) and got[105] == 100


def brute_passages(rows, n=20):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        w, gone = words(t), set()
        for i in range(len(w) - n + 1):
            key = tuple(w[i:i + n])
            if key in seen:
                gone.update(range(i, i + n))
            seen.add(key)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.setdefault(d, []).append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("size", [8 << 20, 2000])
def test_passages(docs, rows, monkeypatch, size):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", size)
    want = brute_passages([(d, t) for d, t, *_ in rows])
    got = {}
    for r in substring_dedup.repeated_passages(docs).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_removed, r.kept_sha256))
    assert {d: sorted(v) for d, v in got.items()} == {d: sorted(v) for d, v in want.items()}


def test_passages_inside_and_across(spark):
    rng = random.Random(1)
    p = [f"p{rng.randrange(10 ** 6)}" for _ in range(45)]
    rows = [(3, " ".join(p)), (1, " ".join(["a", *p[:20], "b", *p[:20], "c"])), (2, " ".join(p[25:45])), (4, " ".join(p[:19])), (5, "x " * 60), (None, " ".join(p[:21]))]
    got = {r.doc_id: r.n_removed for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {None: 0, 1: 40, 2: 0, 3: 41, 4: 0, 5: 59}


def test_cover_has_every_difference():
    n, cover = substring_dedup.PERIOD, substring_dedup.COVER
    assert {(a - b) % n for a in cover for b in cover} == set(range(n))


def test_empty_and_without_ids(empty, no_ids):
    assert jaccard_join.jaccard_components(empty).count() == 0 and substring_dedup.repeated_passages(empty).count() == 0
    assert jaccard_join.jaccard_components(no_ids).count() == 3 and substring_dedup.repeated_passages(no_ids).count() == 3


def test_a_group_of_many_components(spark, monkeypatch):
    """A passage that all share makes one large group of sets that are no copies of one another, besides families that are."""
    monkeypatch.setattr(jaccard_join, "LEAST_CHUNK", 16)
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 6000)
    rng = random.Random(9)
    shared = [f"s{k}" for k in range(70)]
    rows = []
    for k in range(240):
        own = [f"u{rng.randrange(10 ** 6)}" for _ in range(12)] if k % 3 else [f"f{k % 4}-{j}" for j in range(12)]
        w = shared[rng.randrange(6) :] + own
        rows.append((k, " ".join(w)))
    want = brute_components(rows)
    assert len({c for _, c in want.values()}) > 1
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_texts_of_megabytes(spark):
    """Two long texts that differ in a few words, and a passage of one of them elsewhere."""
    a = [f"w{k * k % 99991}" for k in range(300_000)]
    b = list(a)
    b[150_000:150_003] = ["other", "words", "here"]
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(a[200_000:200_025])), (4, None), (5, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == brute_components(rows)
    want = {d: sorted(v) for d, v in brute_passages(rows).items()}
    assert {r.doc_id: [(r.n_words, r.n_removed, r.kept_sha256)] for r in substring_dedup.repeated_passages(docs).collect()} == want
