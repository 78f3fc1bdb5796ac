"""Fingerprints, hard negatives and vector codes against brute force, with every awkward row."""

import hashlib
import math
import random
import struct

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from tarn.llm import fingerprints as fp
from tarn.llm import hard_negatives as hn
from tarn.llm import vector_codes as vc

DENSE = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
TERM = regex.compile(rf"[{DENSE}]|[^\x20\x09-\x0D{DENSE}]{{1,40}}")


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute_samples(text):
    """Ioffe's scheme as he states it, with the operator's draws: (term, t) of every sample."""
    weights = {}
    for t in TERM.findall(text):
        weights[t] = weights.get(t, 0) + 1
    out = []
    for g in range(fp.GROUPS):
        for i in range(fp.EACH):
            best = None
            for term, w in weights.items():
                k = struct.pack("<q", signed(xxhash.xxh64_intdigest(term.encode(), seed=42)))
                x, y = (xxhash.xxh64_intdigest(struct.pack("<i", g * 2 * fp.EACH + 2 * i + j), seed=xxhash.xxh64_intdigest(k, seed=42)) for j in (0, 1))
                v, v2, u, u2 = (((z >> s & 0xFFFFFFFF) + 0.5) * 2.0**-32 for z, s in ((x, 32), (x, 0), (y, 32), (y, 0)))
                r, c, b = -math.log(v * v2), -math.log(u * u2), math.log(v2) / math.log(v * v2)
                t = math.floor(math.log(w) / r + b)
                a = math.log(c) - r * (t - b + 1)
                if best is None or a < best[0]:
                    best = (a, term, t)
            out.append(best and best[1:])
    return out


def brute_fingerprints(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, signed(xxhash.xxh64_intdigest(r[1].encode(), seed=42))))
    made = {t: brute_samples(t) for _, t in rows}
    out = []
    for k, (d, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        m = len(t) // 4
        edited = t[: len(t) - m] + after[:m]
        near = lambda a, b: sum(x == y for x, y in zip(a, b)) / fp.SAMPLES
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), near(made[t], brute_samples(edited)), near(made[t], made[after])))
    return out


def shape(rows):
    return sorted(rows, key=repr)


def test_fingerprints(spark, docs, rows):
    small = [r for r in rows if r[0] < 200][:40] + [(300, "日本語テキストである 日本", "ja", "a", 1), (301, "a a a a a a b b c " * 5, "en", "a", 1), (302, "a a b c " * 9, "en", "a", 1)]
    small += [small[3], small[20], small[20], small[20]]
    table = spark.createDataFrame(small, docs.schema[:5]).repartition(3).withColumns({c: F.lit(c) for c in ("void", "id", "h", "n", "m", "head", "copy", "rows", "term", "first", "g")})
    got = fp.fingerprints(table).collect()
    assert shape((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got) == shape(brute_fingerprints([(d, t) for d, t, *_ in small]))
    texts = {d: t or "" for d, t, *_ in small}
    by = {}
    for r in got:
        assert len(r.fingerprint) == 4 * fp.SAMPLES
        assert by.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    assert len({v for k, v in by.items()}) == len({tuple(brute_samples(k)) for k in by})


def test_fingerprints_of_few_rows(spark, empty, no_ids):
    assert fp.fingerprints(empty).collect() == []
    got = fp.fingerprints(no_ids).collect()
    assert shape((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got) == shape(brute_fingerprints([(r.doc_id, r.text) for r in no_ids.collect()]))
    one = spark.createDataFrame([(5, "one row of some words only")], "doc_id long, text string")
    assert [(r.near_next, r.n_chars) for r in fp.fingerprints(one).collect()] == [(1.0, 26)]


def test_likeness_is_the_weighted_jaccard(spark):
    """Over many pairs the mean of the estimate is the generalised Jaccard similarity."""
    rng = random.Random(1)
    texts = [" ".join(f"w{min(int(rng.expovariate(0.15)), 60)}" for _ in range(rng.randrange(30, 120))) for _ in range(120)]
    got = fp.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()

    def jaccard(a, b):
        a, b = ({w: x.split().count(w) for w in set(x.split())} for x in (a, b))
        return sum(min(a.get(w, 0), b.get(w, 0)) for w in a | b) / sum(max(a.get(w, 0), b.get(w, 0)) for w in a | b)

    error = [r.near_next - jaccard(texts[r.doc_id], texts[(r.doc_id + 1) % len(texts)]) for r in got]
    assert abs(np.mean(error)) < 0.02 and np.std(error) < 0.1


def test_a_long_text(spark):
    text = " ".join(f"w{k % 5000}" for k in range(250_000))  # 1.4 million characters
    got = fp.fingerprints(spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert got[0].n_chars == len(text) and got[0].near_edited > 0.5 and got[0].near_next == 0


VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(n=700, dims=16, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(12, dims))
    rows = []
    for k in range(n):
        v = (middle[k % 12] + 0.4 * rng.normal(size=dims)) / 3
        rows.append((k, [float(np.float32(x)) for x in v], int(rng.integers(0, 10))))
    rows += [(n + k, rows[5][1], 3) for k in range(40)]  # ties
    rows += [(1000, None, 1), (1001, rows[1][1], None), (1002, [None] * dims, 2), (1003, [float("nan")] * dims, 2), (1004, [float("inf")] * dims, 2), (1005, [1.0], 2), (1006, [], 2), (1100, [0.0] * dims, 4), (1200, [-x for x in rows[1][1]], 4)]
    return rows


def finite(v, dims=16):
    return v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)


def brute_negatives(rows, k=5):
    kept = [(i, (y + 1) % 10 if i % 7 == 0 else y, np.array([math.floor(256 * x) for x in v], np.int64)) for i, v, y in rows if i is not None and y is not None and finite(v)]
    out = []
    for a, label, v in kept:
        if a % 100:
            continue
        s = sorted((-int(v @ w), i, y) for i, y, w in kept if i != a)
        for p, pid in [(-x, i) for x, i, y in s if y == label][:k]:
            fits = [(-x, i) for x, i, y in s if y != label and 80 * p <= 100 * -x <= 100 * p]
            out += [(a, pid, r, i, p, x) for r, (x, i) in enumerate(fits[:k], 1)]
    return out


@pytest.mark.parametrize("lists,block,first,anchors", [(1000, 2048, 4, 32768), (90, 16, 2, 2)])
def test_hard_negatives(spark, monkeypatch, lists, block, first, anchors):
    for k, v in {"LIST_ROWS": lists, "BLOCK_ROWS": block, "FIRST": first, "ANCHOR_ROWS": anchors}.items():
        monkeypatch.setattr(hn, k, v)
    rows = vectors()
    table = spark.createDataFrame(rows, VECTORS).repartition(3).selectExpr("*", "1 AS list", "'x' AS anchor_id", "2 AS score")
    got = hn.hard_negatives(table).collect()
    assert sorted(map(tuple, got)) == sorted(brute_negatives(rows))


def test_hard_negatives_of_nothing(spark):
    assert hn.hard_negatives(spark.createDataFrame([], VECTORS)).collect() == []
    assert hn.hard_negatives(spark.createDataFrame([(100, [1.0, 2.0], 1), (None, [1.0, 2.0], 1)], VECTORS)).collect() == []


def test_lists_are_skipped(spark, tmp_path):
    """Lists whose bound is below the kth score aren't visited."""
    from tarn.llm.shared import Scratch

    rng = np.random.default_rng(2)
    middle = np.eye(20) * 40
    rows = [(k, (middle[k % 20] + rng.normal(size=20)).tolist(), 1) for k in range(2000)]
    table = hn.prepared(spark.createDataFrame(rows, VECTORS), 10**9, 10, 1.0)
    old, hn.LIST_ROWS = hn.LIST_ROWS, 100
    try:
        scratch = Scratch(spark, "negatives")
        lists = hn.Lists(table, scratch)
        kept = []
        scratch.drop = lambda *names: kept.extend(names)
        anchors = lists.rows.where("vec_id % 100 = 0").selectExpr("vec_id AS anchor_id", "label", "v")
        lists.search(anchors, None, 5, "p").collect()
        visited = sum(spark.read.parquet(scratch.path(n)).count() for n in kept if "visits" in n)
        assert visited < 20 * 20 / 2  # of 20 anchors and 20 lists
    finally:
        hn.LIST_ROWS = old


def brute_codes(rows, dims=16, parts=8):
    kept = [(i, y, [math.floor(4096 * x) for x in v]) for i, v, y in rows if finite(v, dims)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    w = dims // parts
    cut = lambda v, p: v[p * w:(p + 1) * w]
    books = [[cut(v, p) for _, _, v in kept[:16]] for p in range(parts)]

    def near(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e)), k) for k, e in enumerate(books[p]))

    for _ in range(6):
        own = [[[] for _ in books[p]] for p in range(parts)]
        for _, _, v in kept:
            for p in range(parts):
                own[p][near(v, p)[1]].append(cut(v, p))
        books = [[[sum(c) // len(x) for c in zip(*x)] if x else books[p][k] for k, x in enumerate(own[p])] for p in range(parts)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    coded = [(i, y, [near(v, p) for p in range(parts)]) for i, y, v in kept]
    total = {}
    for _, y, n in coded:
        total[y] = total.get(y, 0) + sum(x for x, _ in n)
    return [(i, "".join(f"{k:02x}" for _, k in n), sum(x for x, _ in n), total[y], digest) for i, y, n in coded]


@pytest.mark.parametrize("block,n", [(8192, 300), (7, 300), (8192, 5)])
def test_vector_codes(spark, monkeypatch, block, n):
    monkeypatch.setattr(vc, "BLOCK_ROWS", block)
    rows = vectors(300)[:n] + [r for r in vectors(300)[300:] if n > 5 or r[1] is None] + [(None, vectors(300)[7][1], None), (3, vectors(300)[9][1], 2)]
    table = spark.createDataFrame(rows, VECTORS).repartition(3).selectExpr("*", "1 AS code", "'x' AS salt", "2 AS error")
    got = vc.vector_codes(table).collect()
    assert shape(map(tuple, got)) == shape(brute_codes(rows))


def test_vector_codes_of_nothing(spark):
    assert vc.vector_codes(spark.createDataFrame([(1, None, 1)], VECTORS)).collect() == []
    got = vc.vector_codes(spark.createDataFrame([(k, [0.5 * k, -0.25, 1.0], k) for k in range(20)], VECTORS)).collect()
    assert len(got) == 20 and all(len(r.code) == 16 for r in got)  # three components in eight parts
    with pytest.raises(Exception, match="aren't longs"):
        vc.vector_codes(spark.createDataFrame([(1, [1e12] * 8, 1)], VECTORS)).collect()
