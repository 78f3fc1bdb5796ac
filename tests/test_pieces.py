"""Python functions on texts get some of a batch's at a time."""

import pyarrow as pa
from pyspark.sql import functions as F

from tarn.functions import pieces
from tarn.operators import chunking, code, snippets


def test_cuts():
    texts = pa.array(["x" * n for n in (5, 5, 90, 1, 0, 3)] + [None])
    edges = pieces.cuts(texts, 10)
    assert edges[0] == 0 and edges == sorted(set(edges)) and pieces.cuts(texts, 1000, 2) == [0, 2, 4, 6, 7]
    assert pieces.cuts(pa.array([], pa.string())) == [0]


def test_pieces_of_a_batch(spark):
    many = pieces.by_pieces("int", pa.int32(), lambda texts, ks: [len(texts) if k is not None else -1 for k in ks])
    rows = spark.range(3000).coalesce(1).select("id", F.when(F.col("id") % 7 != 0, F.repeat(F.lit("ab"), 500)).alias("t"))
    got = rows.select("id", many(F.col("t"), F.col("id")).alias("n")).collect()
    assert len(got) == 3000 and 0 < max(r.n for r in got) <= pieces.BYTES // 1000 * 7 // 6 + 2


def test_functions_on_texts_are_made_of_pieces(spark, monkeypatch):
    """Whatever the pieces, the same rows."""
    docs = spark.createDataFrame([(str(k), f"# h {k}\n" + "word text.\n" * (k * 40)) for k in range(60)] + [("n", None)], "hash string, doc string").coalesce(1)
    files = docs.select("hash", F.lit("a.py").alias("path"), F.lit("def f():\n    pass\n").alias("body"))

    def found():
        cut = snippets.snippets(F.col("doc"), F.lit("text"))
        return [sorted(map(tuple, x.collect())) for x in (chunking.chunk_rows(docs), code.symbols(files), docs.select("hash", cut.alias("s")).select("hash", "s.*"))]

    large = found()
    used = []
    for m in (chunking, code, snippets):
        monkeypatch.setattr(m, "by_pieces", lambda *a, f=pieces.by_pieces: used.append(a[0]) or f(*a))
    monkeypatch.setattr(pieces, "BYTES", 1)
    monkeypatch.setattr(pieces, "ROWS", 1)
    assert found() == large and len(used) == 3 and len(large[0]) > 100
