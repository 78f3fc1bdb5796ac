"""The segmented keyword index against a pass over the texts."""

import random

import numpy as np
import pytest

from tarn.operators import bm25, segments
from tarn.plans.lexquery import parse
from tarn.sources.snapshots import Warehouse

QUERIES = ["w1", '"w1"', '"w0 w1"', '"w0 w1 w2"', '"w0 w0"', "w2 w3", '"w2" "w3"', '"w0" "w1"', "w1 -w2", 'w1 -"w0 w1"', '"w40"', "w4", '"w0 w1 w4', '"nothing"', '"w1 w30 w0"']


def documents(spark, n=600, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        words = [f"w{min(int(rng.expovariate(0.25)), 59)}" for _ in range(rng.randrange(0, 120))]
        rows.append((k, "c", f"d/{k}.md", f"w{k % 7} title", f"h{k}", " ".join(words)))
    return spark.createDataFrame(rows, "doc_id long, collection string, path string, title string, hash string, body string").repartition(3)


def written(spark, root, docs):
    w = Warehouse(spark, str(root))
    w.commit(segments=[w.write_segment(1, segments.single(docs))])
    return w


def answers(df):
    return [(r.doc_id, round(r.score, 9)) for r in df.collect()]


def test_answers_of_one_segment(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "BLOCK", 16)
    monkeypatch.setattr(segments, "WORTH", 2)
    docs = documents(spark)
    scan, index = bm25.Scan(docs), written(spark, tmp_path / "i", docs).keyword_index()
    assert index.known([])[2]  # there are pairs
    used = []
    thresholds = segments.Segmented._thresholds
    monkeypatch.setattr(segments.Segmented, "_thresholds", lambda self, *a: used.append(thresholds(self, *a)) or used[-1])
    for q in QUERIES:
        want = answers(bm25.search(scan, docs, parse(q), 10))
        assert answers(bm25.search(index, docs, parse(q), 10)) == want, q
    assert sorted(answers(bm25.matches(index, parse("w1 -w2")))) == sorted(answers(bm25.matches(scan, parse("w1 -w2"))))
    assert used[0] is not None
    read = lambda least: index.postings.where("term = 'w1'").where(least["w1"] if least else "true").count()
    assert read(used[0]) < read(None) / 2  # blocks are skipped
    assert sorted(map(tuple, index.dictionary().collect())) == sorted(map(tuple, bm25.Postings.build(docs).dictionary().collect()))


def test_a_phrase_of_frequent_words_reads_pairs(spark, tmp_path):
    docs = documents(spark)
    index = written(spark, tmp_path / "i", docs).keyword_index()
    paired = set(index.known([])[2])
    assert {"w0", "w1", "w2"} <= paired
    assert [s[1] for s in index.slots(parse('"w0 w1 w2"').positive[0], paired)] == ["w0 w1", "w1 w2"]
    assert [s[1] for s in index.slots(parse('"w0 w1"').positive[0], paired)] == ["w0 w1"]
    assert [s[1] for s in index.slots(parse('"w40 w0 w1"').positive[0], paired)] == ["w40", "w0 w1"]


def test_a_row_is_sorted_for_a_term_and_many_documents(spark, tmp_path, monkeypatch):
    docs = documents(spark)
    rows = segments.inverted(docs, "simple", ["w0", "w1"]).collect()
    places = {r.term: sum(len(x.places) // 4 for x in rows if x.term == r.term) for r in rows}
    assert len(rows) <= len(places) * docs.rdd.getNumPartitions() < sum(places.values()) / 10  # it was a row a place
    assert {t: n for t, n in places.items() if " " not in t} == {r.term: r.cf for r in bm25.Postings.build(docs).dictionary().collect()}
    assert all(sum(np.frombuffer(r.docs, segments._DOCUMENT)["count"]) == len(r.places) // 4 for r in rows)
    # a term's places are more than what is looked at together
    monkeypatch.setattr(segments, "PIECE", 200)
    index = written(spark, tmp_path / "i", docs).keyword_index()
    assert max(r.cf for r in index.postings.select("cf").collect()) <= 200 + 120 < places["w0"]
    for q in ('"w0 w1"', "w2 w3", 'w1 -"w0 w1"', '"w0" "w1"'):
        assert answers(bm25.search(index, docs, parse(q), 10)) == answers(bm25.search(bm25.Scan(docs), docs, parse(q), 10)), q


def test_updates_and_merges_equal_a_rebuild(spark, tmp_path):
    rng, w = random.Random(4), Warehouse(spark, str(tmp_path / "i"))
    state: dict[int, str] = {}
    frame = lambda rows: spark.createDataFrame([(k, "c", f"{k}.md", "t", "h", b) for k, b in rows], "doc_id long, collection string, path string, title string, hash string, body string")
    known, merges = [], 0
    for number in range(1, 8):
        new = {rng.randrange(40): " ".join(f"w{rng.randrange(9)}" for _ in range(rng.randrange(1, 30))) for _ in range(40 if number == 1 else 5)}
        lost = set(rng.sample(sorted(state), min(len(state), 2))) - set(new)
        gone = [(k, state[k]) for k in [*lost, *new] if k in state]
        state = {k: b for k, b in (state | new).items() if k not in lost}
        paired = ["w1", "w2"]
        marks = frame(gone).select("doc_id")
        known.append(w.write_segment(number, segments.made(frame(new.items()), frame(gone), "simple", number, paired, marks)))
        run = [n for n, *_ in known[-3:]] if number == 4 else [n for n, *_ in known] if number == 7 else None
        if run:
            merges += 1
            one = w.write_segment(run[-1], segments.merged(w.read_segments([k for k in known if k[0] in run]), run, run[0] == known[0][0]))
            known = [*(k for k in known if k[0] not in run), one]
        w.commit(segments=known)
        index, docs = w.keyword_index(), frame(state.items())
        assert sorted(map(tuple, index.dictionary().collect())) == sorted(map(tuple, bm25.Postings.build(docs).dictionary().collect()))
        for q in ('"w1"', "w", '"w1 w2"', '"w3 w1 w2" -w5'):
            assert sorted(answers(bm25.matches(index, parse(q)))) == sorted(answers(bm25.matches(bm25.Scan(docs), parse(q)))), (number, q)
    assert len(known) == 1 and w.read_segments()["marks"].count() == 0
    w.vacuum()
    assert sorted(answers(bm25.matches(w.keyword_index(), parse("w")))) == sorted(answers(bm25.matches(bm25.Scan(docs), parse("w"))))


@pytest.mark.parametrize("sizes,want", [([100, 5], None), ([100, 1, 1, 1, 1], [2, 3, 4, 5]), ([9, 9, 9, 9], [1, 2, 3, 4]), ([1000, 9, 3, 2], None), ([10, 10, 3, 1, 1], [1, 2, 3, 4, 5])])
def test_which_segments_are_merged(sizes, want):
    assert segments.to_merge(list(enumerate(sizes, 1))) == want


def test_nothing_to_index(spark, tmp_path):
    docs = documents(spark, 3).where("false")
    index = written(spark, tmp_path / "i", docs).keyword_index()
    assert index.best(parse("a"), 5).count() == 0 and index.best(parse('"a"'), 5).count() == 0
