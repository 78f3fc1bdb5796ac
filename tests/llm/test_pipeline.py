"""The pipeline's stages on awkward rows, and the registered queries."""

import pytest


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, rows[30][1][:200])], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{d}/none/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/none/benchmark.parquet")
    return str(d)


def test_stages(spark, rows, folder):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in c.STAGES:
        before = docs
        docs = c.Scratch(spark, "test").table(stage(spark, docs, folder), name)
        seen[name] = [r.doc_id for r in docs.collect()]
        assert set(seen[name]) <= {r.doc_id for r in before.collect()}
        if name != "sentencepiece":
            assert docs.columns == columns
    assert not {1, 2, 3, 8} & set(seen["language_id"])
    assert len(set(seen["exact_dedup"])) == len(seen["exact_dedup"])  # of repeated rows one stays
    assert 7 in seen["exact_dedup"] and 6 not in seen["exact_dedup"] and 5 in seen["exact_dedup"]  # 6 and 7 are equal, 7 is longer
    assert seen["sentencepiece"] and docs.where("NOT decoded").count() == 0
    assert sorted(r.doc_id for r in c.run(spark, folder).collect()) == sorted(seen["sentencepiece"])


def test_all_stages_by_brute_force(spark, rows, folder):
    """The five stages again in plain Python."""
    import re
    import zlib

    import corpus_pipeline as c
    import numpy as np
    import public_tokenizers
    import sentencepiece
    from test_pairs import brute_components

    kept = [(d, t) for d, t, *_ in rows if t and re.search(r"[^\W\d_]", t)]
    groups = {}
    for d, t in kept:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), d, t))
    kept = [min(g)[1:] for g in groups.values()]
    parts = brute_components(kept)
    kept = [(d, t) for d, t in kept if parts[d][1] == d]
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    windows = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    item = words(rows[30][1][:200])
    kept = [(d, t) for d, t in kept if not windows(words(t), 10) & windows(item, 10)]
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((d, len(i := lib.encode(t)), zlib.crc32(np.array(i, "<u4").tobytes())) for d, t in kept)
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in c.run(spark, folder).collect()) == want
    assert 3 < len(want) < len(rows) - 10


def test_clashing_columns_and_missing_ids(spark, docs, folder):
    import corpus_pipeline as c
    from pyspark.sql import functions as F

    names = ("gone_id", "kept_id", "kept_sha", "own_sha", "place", "h")
    more = spark.createDataFrame([(None, "some text of one", "en", None, None), (None, "some text of one", "en", None, None), (500, "some text  of one", "en", None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = docs.unionByName(more, allowMissingColumns=True).withColumns({n: F.lit(n) for n in names})
    for name, stage in c.STAGES:
        out = c.Scratch(spark, "test").table(stage(spark, rows, folder), name)
        if name != "sentencepiece":
            assert out.columns == rows.columns
            assert out.count() == out.where("gone_id = 'gone_id' AND place = 'place'").count() > 0
        rows = out
    ids = [r.doc_id for r in rows.collect()]
    assert 500 in ids and None not in ids and len(set(ids)) == len(ids)


def test_empty(spark, folder):
    import corpus_pipeline as c

    assert c.run(spark, f"{folder}/none").count() == 0


def test_queries_are_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{k}" for k in range(1, 11)} and "pipeline" in names
    assert set(e.oracle_sql()) <= names
