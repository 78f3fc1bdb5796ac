"""Keyword search against SQLite's FTS5, vectors and fusion against plain arithmetic, metrics and rubric."""

import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.operators import bm25, evaluation, expansion, formatters, fusion, lookup, maintenance, vectors
from tarn.plans.lexquery import parse


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    words = "run running runner auth authentication databases data base café naïve score scoring multi agent memory 2026 4 10 the of and systems index indexing".split() + ["multi agent"] * 2
    rows = [(k, f"c{k % 3}", f"d{k % 5}/f{k}.md", " ".join(rng.choice(words) for _ in range(2)), " ".join(rng.choice(words) for _ in range(rng.randrange(3, 60)))) for k in range(1, 60)]
    return rows, spark.createDataFrame(rows, "doc_id long, collection string, path string, title string, body string").withColumn("hash", F.sha2("body", 256))


QUERIES = {
    "running": '"running"*', '"multi agent"': '"multi agent"', "multi-agent memory": '"multi agent" AND "memory"*', "data -base": '"data"* NOT "base"*', "2026.4": '"2026"* AND "4"*',
    'index -"the of"': '"index"* NOT "the of"', "auth": '"auth"*', "cafe": '"cafe"*', "the": '"the"*', "c1 score": '"c1"* AND "score"*',
}


@pytest.mark.parametrize("text", list(QUERIES))
@pytest.mark.parametrize("indexed", [False, True])
def test_bm25_equals_fts5(corpus, text, indexed):
    rows, docs = corpus
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(filepath, title, body, tokenize='porter unicode61')")
    db.executemany("insert into t(rowid, filepath, title, body) values (?, ?, ?, ?)", [(k, f"{c}/{p}", t, b) for k, c, p, t, b in rows])
    want = {k: -s / (1 - s) for k, s in db.execute("select rowid, bm25(t, 1.5, 4.0, 1.0) from t where t match ?", (QUERIES[text],))}
    index = bm25.Postings.build(docs, "porter") if indexed else bm25.Scan(docs, "porter")
    got = {r.doc_id: r.score for r in bm25.matches(index, parse(text, "porter")).collect()}
    assert got.keys() == want.keys() and want
    assert all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_only_excluded_finds_nothing(corpus):
    _, docs = corpus
    assert bm25.search(bm25.Scan(docs), docs, parse("-a")).count() == 0


def test_vectors(spark):
    large = [(f"h{k}", 0, 0, [1.0, 0.0, 0.0, k / 1000]) for k in range(50)]
    rows = [*large, ("s", 0, 0, [0.6, 0.8, 0.0, 0.0]), ("z", 0, 0, [0.0] * 4), ("s", 1, 9, [0.0, 1.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "hash string, seq int, pos int, embedding array<float>")
    docs = spark.createDataFrame([(k, "large", f"p{k}", "t", f"h{k}") for k in range(50)] + [(100, "small", "q", "t", "s"), (101, "small", "r", "t", "s"), (102, "small", "zero", "t", "z")], "doc_id long, collection string, path string, title string, hash string")
    top = vectors.search_vectors(v, docs, [1, 0, 0, 0], 3).collect()
    assert [r.collection for r in top] == ["large"] * 3 and top[0].score == pytest.approx(1)
    small = vectors.search_vectors(v, docs, [1, 0, 0, 0], 3, ["small"]).collect()
    assert [(r.doc_id, r.seq) for r in small[:2]] == [(100, 0), (101, 0)] and small[0].score == pytest.approx(0.6)
    both = vectors.search_vectors_each(v, docs, [1, 0, 0, 0], 2, ["large", "small"]).collect()
    assert len(both) == 2
    vectors.check_dimensions(v, 4)
    with pytest.raises(vectors.DimensionError):
        vectors.check_dimensions(v, 8)


def test_nearest(spark):
    rng = np.random.default_rng(1)
    m = rng.standard_normal((300, 8)).astype(np.float32)
    m[250:260] = m[0]
    v = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(m)], "vec_id long, embedding array<float>").repartition(3)
    got = vectors.nearest(v, v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 5).collect()
    n = m.astype(float) / np.linalg.norm(m.astype(float), axis=1)[:, None]
    for q in range(0, 300, 20):
        d = np.round(1 - n @ n[q], 12)
        want = sorted(range(300), key=lambda k: (d[k], k))[:5]
        assert sorted(r.vec_id for r in got if r.query_id == q) == sorted(want)


def lists_frame(spark, *lists, weights=None):
    rows = [(0, k, "fts", "original" if k == 0 else "lex", "q", f, r, 1.0, float((weights or {}).get(k, 1.0))) for k, x in enumerate(lists) for r, f in enumerate(x)]
    return spark.createDataFrame(rows, "query_id long, list_idx int, source string, query_type string, query string, file string, rank0 int, backend_score double, weight double")


def test_fusion(spark):
    frame = lists_frame(spark, "abcd", "cxa", weights={0: 2.0})
    got = {r.file: r for r in fusion.fused_rank(fusion.fuse(frame)).collect()}
    assert got["a"].score == pytest.approx(2 / 61 + 1 / 63 + 0.05) and got["c"].score == pytest.approx(2 / 63 + 1 / 61 + 0.05)
    assert got["x"].score == pytest.approx(1 / 62 + 0.02) and got["d"].score == pytest.approx(2 / 64)
    assert [f for f, _ in sorted(got.items(), key=lambda x: x[1].fused_rank)] == ["a", "c", "b", "x", "d"]
    t = {r.file: r for r in fusion.trace(frame).collect()}
    assert t["a"].total == pytest.approx(got["a"].score) and [c["rank"] for c in t["a"].contributions] == [1, 3] and t["b"].best_rank == 2
    tie = fusion.fused_rank(fusion.fuse(lists_frame(spark, "ab", "ba"))).orderBy("fused_rank").collect()
    assert [r.file for r in tie] == ["a", "b"]


def test_blend(spark):
    rows = spark.createDataFrame([(r, 0.5) for r in (1, 3, 4, 10, 11)], "r int, s double").select("r", fusion.blended(F.col("r"), F.col("s")).alias("b")).collect()
    for r in rows:
        w = 0.75 if r.r <= 3 else 0.6 if r.r <= 10 else 0.4
        assert r.b == pytest.approx(w / r.r + (1 - w) * 0.5)


def test_best_chunk(spark):
    one = spark.sql("select array(named_struct('text', 'nothing'), named_struct('text', 'Foo bar'), named_struct('text', 'foo bar')) as c")
    assert one.select(fusion.best_chunk(F.col("c"), ["foo", "bar"])).first()[0] == 1
    assert one.select(fusion.best_chunk(F.col("c"), [], ["nothing"])).first()[0] == 0
    assert fusion.chunk_terms("is the Foo") == ["the", "foo"]


def test_metrics(spark):
    results = spark.createDataFrame([(1, "b", r, f) for r, f in enumerate(["tarn://c/x.md", "tarn://c/docs/A.md", "tarn://c/y.md", "tarn://c/b.md"], 1)], "query_id long, backend string, rank int, file string")
    expected = spark.createDataFrame([(1, "docs/a.md"), (1, "b.md"), (1, "zz.md")], "query_id long, file string")
    m = evaluation.retrieval_metrics(results, expected, 3).first()
    assert (m.hits_at_k, m.total_expected) == (1, 3) and m.precision_at_k == pytest.approx(1 / 3) and m.recall == pytest.approx(2 / 3)
    assert m.mrr == 0.5 and m.recall_at_1 == 0 and m.f1 == pytest.approx(2 * (1 / 3) * (2 / 3) / 1)


def test_contexts_and_resolution(spark):
    docs = spark.createDataFrame([("c", "a/x.md", "h1aaaa"), ("c", "b/x.md", "h2"), ("d", "y.md", "abcdef12")], "collection string, path string, hash string")
    rules = spark.createDataFrame([("c", "/", "all of c"), ("c", "a", "part a")], "collection string, prefix string, context string")
    got = {r.path: r.context for r in lookup.contexts(docs, rules, "top").collect()}
    assert got == {"a/x.md": "top\n\nall of c\n\npart a", "b/x.md": "top\n\nall of c", "y.md": "top"}
    names = spark.createDataFrame([(n,) for n in ("x.md", "a/x.md", "tarn://d/y.md", "#abcdef", "no", "c/b/x.md")], "name string")
    r = {x.name: (x.status, x.path) for x in lookup.resolve(docs, names).collect()}
    assert r == {"x.md": ("ambiguous", None), "a/x.md": ("found", "a/x.md"), "tarn://d/y.md": ("found", "y.md"), "#abcdef": ("found", "y.md"), "no": ("missing", None), "c/b/x.md": ("found", "b/x.md")}


def test_pages(spark):
    docs = spark.createDataFrame([(i, i % 3 > 0) for i in range(1, 10)], "id long, active boolean")
    seen, after = [], 0
    while some := [r.id for r in maintenance.page(docs, "id", after, 4).collect()]:
        seen, after = seen + [some], some[-1]
    assert seen == [[1, 2, 4, 5], [7, 8]]
    for n in (0, -1, 1.5, True):
        with pytest.raises(ValueError):
            maintenance.page(docs, "id", 0, n)


def test_formats(spark):
    row = spark.createDataFrame([("abc123", 0.5, "c/a.md", 'T "q"', "ctx", 3, "l1\nl2")], "docid string, score double, file string, title string, context string, line int, snippet string")
    assert formatters.format_search(row, "csv").split("\n")[1] == '#abc123,0.5000,c/a.md,"T ""q""",ctx,3,"l1'
    assert formatters.format_search(row, "files") == '#abc123,0.50,c/a.md,"ctx"'
    assert '<file docid="#abc123" name="c/a.md" title="T &quot;q&quot;" context="ctx">\nl1\nl2\n</file>' == formatters.format_search(row, "xml")
    assert "1: l1\n2: l2" in formatters.format_search(row, "md", line_numbers=True)
    assert formatters.search_summary(row, "q") == 'Found 1 result for "q":\n\n#abc123 50% c/a.md - T "q"'
    assert formatters.search_summary(row.where("false"), "q") == 'No results found for "q"'
    none = row.where("false")
    assert [formatters.format_search(none, f) for f in ("json", "xml", "md")] == ["[]", "<results></results>", ""]
    assert formatters.format_search(none, "csv") == "docid,score,file,title,context,line,snippet"
    doc = spark.createDataFrame([("a.md", "T", None, "body", False, None), ("b.md", "b.md", "ctx", None, True, "too large")], "file string, title string, context string, body string, skipped boolean, skip_reason string")
    assert formatters.format_documents(doc, "files") == 'a.md\nb.md,"ctx",[SKIPPED]'
    assert "> too large" in formatters.format_documents(doc, "md") and "<skipped>true</skipped>" in formatters.format_documents(doc, "xml")


def test_changes(spark):
    old = spark.createDataFrame([("c", "same", "t", "h", True), ("c", "upd", "t", "h", True), ("c", "ret", "t", "h", True), ("c", "rem", "t", "h", True), ("c", "back", "t", "h", False), ("c", "gone", "t", "h", False)], "collection string, path string, title string, hash string, active boolean")
    new = spark.createDataFrame([("c", "same", "t", "h"), ("c", "upd", "t", "h2"), ("c", "ret", "t2", "h"), ("c", "back", "t", "h"), ("c", "new", "t", "h")], "collection string, path string, title string, hash string")
    got = {r.path: r.change for r in maintenance.changes(old, new).collect()}
    assert got == {"same": "unchanged", "upd": "updated", "ret": "retitled", "rem": "removed", "back": "reactivated", "gone": "gone", "new": "added"}


def test_batches(spark):
    rows = spark.createDataFrame([(f"h{k}", f"p{k}", b) for k, b in enumerate([10, 50, 50, 200, 5])], "hash string, path string, n_bytes long").coalesce(1)
    assert [r.batch for r in maintenance.batches(rows, 2, 100).orderBy("path").collect()] == [0, 0, 1, 2, 3]


@pytest.mark.parametrize("query,text,rating,percentage", [
    ("Bob React hooks guide", 'lex: react hooks\nlex: bob "react" effects\nvec: how to use react hooks with Bob\nhyde: React hooks let function components use state and effects in a simple manner.', "Excellent", 100.0),
    ("auth", "lex: auth\nvec: auth", "Acceptable", 50.0), ("x /only:lex", "lex: foo bar\nlex: baz quux x", "Excellent", 83.3), ("a", "junk", "Failed", 0.0), ("a", "lex: <|im_start|>", "Failed", 0.0), ("a /only:vec", "lex: b", "Failed", 0.0),
])
def test_rubric(spark, query, text, rating, percentage):
    s = expansion.rubric(spark.createDataFrame([(query, text)], "query string, expansion string")).first().score
    assert (s.rating, s.percentage) == (rating, percentage)


#: What the rubric says of expansions, by part: worked out by hand from its rules.
RUBRIC = [
    ("SetUp docker swarm", "lex: docker\nvec: x", dict(format=30, diversity=30, hyde=0, quality=12, entity=10, think_bonus=20, total=102, max_possible=120, entities=[])),
    ("x y", "<think>a</think>lex: x one\nvec: y the other long thing", dict(format=30, diversity=30, quality=20, entity=10, think_bonus=0, total=90, percentage=75.0, rating="Good")),
    ("Bob likes tea", "lex: green tea\nvec: what kind of tea is liked", dict(entity=0, entities=["bob", "likes"], deductions=["entities lost: bob, likes"])),
    ("auth", "lex: auth", dict(format=20, deductions=["capped: 1 lex echoes", "missing vec:"], percentage=50.0)),
    ("tea /only:vec", "vec: which tea is best of all\nlex: tea", dict(format=20, diversity=15, quality=20, entity=10, total=85, only_mode="vec", deductions=["more than vec:"])),
    (None, None, dict(format=10, total=60)),
]


def test_rubric_by_part(spark):
    rows = spark.createDataFrame([(k, q, e) for k, (q, e, _) in enumerate(RUBRIC)], "k int, query string, expansion string")
    for r in expansion.rubric(rows).collect():
        want = RUBRIC[r.k][2]
        got = r.score.asDict()
        assert {k: got[k] for k in want} == want, r.k


def test_rubric_predicates(spark):
    one = spark.range(1)
    said = lambda c: one.select(c.alias("x")).first().x
    L = F.lit
    assert said(expansion.entities(L("TDS motorsports team uses node.js"))) == ["motorsports", "node.js", "tds"]
    assert said(expansion.entities(L("SetUp docker swarm"))) == []  # a verb with a capital inside is a verb still
    assert said(expansion.entities(L("Configure the API"))) == ["api"] and said(expansion.entities(L("how is it"))) == []
    assert said(expansion.is_generic(L("find information about"))) and not said(expansion.is_generic(L("react hooks")))
    assert said(expansion.echoes(L("auth setup"), L("auth"))) and not said(expansion.echoes(L("a much longer text on auth and its setup"), L("auth")))
    assert said(expansion.has_filler(L("rome overview"), L("ancient rome"))) and not said(expansion.has_filler(L("rome overview"), L("overview of rome")))
    assert said(expansion.repetition(L("word word word word other"))) == 4


def test_expansion_columns(spark):
    rows = spark.createDataFrame([("How do I", [("vec", " b "), ("lex", "a"), ("hyde", "c"), ("odd", "d"), ("lex", " ")])], "query string, output array<struct<type:string,text:string>>")
    assert rows.select(expansion.output_text(F.col("output"))).first()[0] == "hyde: c\nlex: a\nvec: b"
    assert rows.select(expansion.has_type(F.col("output"), "hyde")).first()[0]
    q = spark.createDataFrame([(x,) for x in ("two words", "the latest news on it", "how to do it now", "what is it all about", "a versus b or c", "my journal of the day", "some other plain thing", "see The Big House")], "q string")
    assert [r[0] for r in q.select(expansion.category(F.col("q"))).collect()] == ["short_keyword", "temporal", "how_to", "what_is", "comparison", "personal", "other", "named_entity"]
    assert q.limit(1).select(expansion.only_mode(F.lit("x  /only:VEC "))).first()[0] == "vec"
    assert q.limit(1).select(expansion.prompt_query(F.lit("/no_think Expand this search query: abc<|im_end|>x"))).first()[0] == "abc"
