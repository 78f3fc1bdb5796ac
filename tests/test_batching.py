"""Greedy batches against a loop."""

import random

import pytest

from tarn.operators import batching


def loop(sizes, most_docs, most_bytes):
    out, batch, n, size = [], 0, 0, 0
    for b in sizes:
        if n and (n >= most_docs or size + b > most_bytes):
            batch, n, size = batch + 1, 0, 0
        n, size = n + 1, size + b
        out.append(batch)
    return out


@pytest.mark.parametrize("n,most_docs,most_bytes", [(0, 4, 10), (1, 4, 10), (97, 4, 10), (97, 1, 10), (60, 7, 1000), (150, 16, 40)])
def test_batches(spark, n, most_docs, most_bytes):
    rng = random.Random(n + most_docs)
    sizes = [rng.choice([0, 1, 2, 3, 5, 9, 30]) for _ in range(n)]
    rows = spark.createDataFrame([(k, None if b == 0 else b) for k, b in enumerate(sizes)], "k long, n_bytes long").repartition(3)
    got = batching.greedy_batches(rows, ["k"], most_docs, most_bytes, lambda d: d.checkpoint()).orderBy("k").collect()
    assert [r.batch for r in got] == loop(sizes, most_docs, most_bytes)


def test_maps_agree_with_a_loop():
    rng = random.Random(3)
    for _ in range(300):
        m, most = rng.randrange(1, 7), rng.randrange(1, 12)
        own, after = ([rng.randrange(0, 9) for _ in range(m)] for _ in range(2))
        begin, n = batching._map_of(own, after, m, most)
        for o in range(m):
            numbers = loop((own + after)[o:], m, most)
            starts = [o + k for k, b in enumerate(numbers) if not k or b != numbers[k - 1]]
            assert n[o] == sum(s < m for s in starts)
            later = [s - m for s in starts if s >= m]
            assert not later or begin[o] == later[0]
