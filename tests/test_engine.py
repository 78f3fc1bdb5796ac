import os

import pytest
from pyspark.sql import functions as F

from tarn.engine import Engine, EngineError
from tarn.sources import files


@pytest.fixture(scope="module")
def notes(tmp_path_factory):
    d = tmp_path_factory.mktemp("notes")
    texts = {
        "a.md": "# Alpha\n\nThe running systems of authentication with multi-agent memory 2026.4.10\n", "sub/b.md": "# Beta\nSomething about databases and performance of sports\n" * 3,
        "sub/blank.md": "  \n", ".git/x.md": "hidden", "node_modules/y.md": "left out", "skip/z.md": "ignored", "other.txt": "no pattern",
    } | {f"n{k}.md": f"# Noise {k}\nunrelated words number {k}\n" for k in range(5)}
    for name, text in texts.items():
        (d / name).parent.mkdir(exist_ok=True)
        (d / name).write_text(text)
    return d


def test_engine(spark, notes, tmp_path):
    e = Engine(spark, f"{tmp_path}/index")
    e.add_collection("notes", str(notes), ignore=["skip/**"])
    with pytest.raises(EngineError):
        e.add_collection("no name", "/")
    assert e.update() == {"indexed": 7, "updated": 0, "unchanged": 0, "removed": 0}
    os.remove(notes / "n4.md")
    (notes / "n3.md").write_text("# Changed\nfresh text")
    assert e.update() == {"indexed": 0, "updated": 1, "unchanged": 5, "removed": 1}
    assert e.health().first().needs_embedding == 6
    assert e.embed() == {"chunks": 6, "incomplete": 0} and e.health().first().needs_embedding == 0 and e.embed()["chunks"] == 0

    assert [r.path for r in e.search_lex("authenticating").collect()] == ["a.md"] and e.search_lex("performance -sports").count() == 0
    assert e.search("databases performance")[0].file == "notes/sub/b.md"
    found = e.search('lex: "multi agent"\nvec: memory of agents\nintent: agent notes', explain=True)
    assert found[0].file == "notes/a.md" and found[0].explain["fusion"]["best_rank"] == 1
    assert "multi-agent" in e.snippet_of(found[0], "multi-agent").snippet
    assert e.search_vector("databases and performance of sports", least=0.1)[0].file == "notes/sub/b.md"
    assert e.search_structured([("lex", "databases")])[0].file == "notes/sub/b.md"

    e.set_context("notes", "/sub", "the sub folder")
    e.set_global_context("everything")
    assert e.get("b.md")["context"] == "everything\n\nthe sub folder" and e.get("#" + e.get("a.md")["docid"])["path"] == "a.md"
    missing = e.get("aa.md")
    assert missing["error"] == "missing" and missing["similar"][0] == "a.md"
    assert e.get("notes/skip/z.md")["ignored_by"] == ("notes", "skip/**")
    assert e.get_body("a.md", 1, 1) == "# Alpha" and e.get_body("nope") is None
    docs, errors = e.multi_get("sub/*.md")
    assert [r.file for r in docs.collect()] == ["tarn://notes/sub/b.md"] and not errors
    docs, errors = e.multi_get("a.md, zzz", most_bytes=10)
    assert docs.first().skipped and errors == ["zzz: missing"]
    assert [r.path for r in e.list_files("notes", "sub").collect()] == ["sub/b.md"]

    gone = {"inactive_documents": 1, "orphaned_content": 1, "orphaned_vectors": 0, "cached_responses": 0}
    assert e.preview_cleanup() == gone and e.cleanup() == gone and not any(e.preview_cleanup().values())
    e.rename_collection("notes", "n2")
    assert e.search_lex("databases").first().collection == "n2" and e.list_contexts() == [("*", "/", "everything"), ("n2", "/sub", "the sub folder")]
    with pytest.raises(EngineError):
        e.rename_collection("notes", "x")
    e.clear_embeddings("n2")
    assert e.health().first().needs_embedding == 6
    assert e.remove_collection("n2") == 6 and e.list_collections().count() == 0


def test_failed_embeddings_are_left(spark, notes, tmp_path):
    from tarn import providers
    from tarn.plans.search import Models

    class Some(providers.HashEmbedder):
        name = "some"

        def embed(self, texts):
            return [None if "Beta" in t else v for t, v in zip(texts, super().embed(texts))]

    e = Engine(spark, f"{tmp_path}/index", models=Models(Some(8), providers.PlainExpander(), providers.OverlapReranker()))
    e.add_collection("notes", str(notes), "*.md, sub/*.md")
    e.update()
    e.embed()
    assert [r.path for r in e.pending().collect()] == ["sub/b.md"]


def test_config(spark, notes, tmp_path):
    path = str(tmp_path / "c.yml")
    config = {"global_context": "g", "collections": {"notes": {"path": str(notes), "pattern": "**/*.md", "context": {"/": "c"}}}}
    files.save_config(path, config)
    assert files.load_config(path) == config and files.load_config(str(tmp_path / "none.yml")) == {"collections": {}}
    e = Engine(spark, f"{tmp_path}/index", path)
    assert not e.sync_config(config) and e.list_contexts() == [("*", "/", "g"), ("notes", "/", "c")] and e.default_collections() == ["notes"]


def test_examples(spark, tmp_path):
    good = '{"query": "q", "output": [["lex", "a"], ["hyde", "b"]], "extra": 1}\n\n'
    (tmp_path / "good.jsonl").write_text(good)
    assert files.load_examples(spark, f"{tmp_path}/good.jsonl").first().output[1].text == "b"
    for k, bad in enumerate(('{"query": " ", "output": [["lex", "a"]]}', '{"query": "q", "output": []}', '{"query": "q", "output": [["odd", "a"]]}', "not json", '{"query": "q", "output": [["lex", ""]]}')):
        (tmp_path / f"bad{k}.jsonl").write_text(good + bad)
        with pytest.raises(files.ExampleError):
            files.load_examples(spark, f"{tmp_path}/bad{k}.jsonl")
    (tmp_path / "golden.jsonl").write_text(
        '{"query": "q", "searches": [{"type": "lex", "query": "a"}]}\n'
        '{"messages": [{"role": "user", "content": "/no_think Expand this search query: w x"}, {"role": "assistant", "content": "<think>t</think>lex: a\\nodd\\nvec: b c<|im_end|>"}]}\n'
    )
    rows = {r.query: [tuple(s) for s in r.searches] for r in files.load_golden(spark, f"{tmp_path}/golden.jsonl").collect()}
    assert rows == {"q": [("lex", "a")], "w x": [("lex", "a"), ("vec", "b c")]}


def test_follow(spark, notes, tmp_path):
    from tarn.streaming.follow import follow

    e = Engine(spark, f"{tmp_path}/index")
    e.add_collection("m", str(notes))
    q = follow(e, "m", f"{tmp_path}/checkpoint")
    q.awaitTermination(120)
    assert e.status().first().n_active > 3


def test_commits_are_whole(spark, tmp_path):
    from tarn.sources.snapshots import Warehouse

    w = Warehouse(spark, f"{tmp_path}/w")
    assert w.read("config").count() == 0
    w.commit(config=spark.createDataFrame([("a", "1")], "key string, value string"))
    before = w.read("config")
    w.commit(config=w.read("config").unionByName(spark.createDataFrame([("b", "2")], "key string, value string")))
    assert before.count() == 1 and w.read("config").count() == 2 and w.vacuum() == 1 and w.read("config").count() == 2


def test_benchmark_fixture(spark, notes, tmp_path):
    import json

    from tarn.plans.benchmark import FixtureError, load_fixture, run_fixture

    e = Engine(spark, f"{tmp_path}/index")
    e.add_collection("notes", str(notes), "**/*.md", ignore=["skip/**"])
    e.update()
    e.embed()
    fixture = {"description": "d", "version": 1, "collection": "notes", "queries": [{"id": "q1", "query": "databases performance", "type": "exact", "description": "", "expected_files": ["sub/b.md"], "expected_in_top_k": 3}]}
    (tmp_path / "f.json").write_text(json.dumps(fixture))
    f = load_fixture(spark, f"{tmp_path}/f.json")
    rows = {r.backend: r for r in run_fixture(spark, e._searched(), e.models, f).collect()}
    assert set(rows) == {"bm25", "vector", "hybrid", "full"} and rows["bm25"].mrr == 1 and rows["full"].precision_at_k == 1
    f.collection = "none"
    with pytest.raises(FixtureError):
        run_fixture(spark, e._searched(), e.models, f)
    assert e.check_embeddings().where("NOT ok").count() == 0
    assert not e.adopt_embeddings()  # all of them name their fingerprint
    unnamed, own = e.tables.read("chunks").withColumn("fingerprint", F.lit("")), e.tables.read("vectors")
    e.tables.commit(chunks=unnamed, vectors=own.withColumn("embedding", F.reverse("embedding")))
    assert e.pending().count() and not e.adopt_embeddings() and e.pending().count()  # these vectors are others
    e.tables.commit(vectors=e.tables.read("vectors").withColumn("embedding", F.reverse("embedding")))
    assert e.adopt_embeddings() and not e.pending().count()
    e.search("databases")
    e.save_cache()
    n = len(e.models.cache)
    e.models.cache.clear()
    assert e.load_cache() == n == len(e.models.cache) and e.expand_query("databases") == [("hyde", "Information about databases")]
    assert e.get_body("a.md:1:1") == "# Alpha"


def test_legacy_paths(spark):
    from tarn.operators import maintenance

    old = spark.createDataFrame([("c", "a-b.md", True), ("c", "x-y.md", True), ("c", "p-q.md", False)], "collection string, path string, active boolean")
    new = spark.createDataFrame([("c", "a b.md"), ("c", "a_b.md"), ("c", "x y.md"), ("c", "x-y.md"), ("c", "p q.md")], "collection string, path string")
    assert [tuple(r) for r in maintenance.adopted_paths(old, new).collect()] == [("c", "a-b.md", "a b.md")]
    assert sorted(r.path for r in maintenance.with_adopted_paths(old, new).collect()) == ["a b.md", "p-q.md", "x-y.md"]


def test_ranges():
    from tarn.operators.lookup import split_range

    assert split_range("a.md") == ("a.md", None, None) and split_range("tarn://c/a.md:5") == ("tarn://c/a.md", 5, None) and split_range("a:b.md:0:3") == ("a:b.md", 1, 3)


def test_every_text_is_embedded_once(spark, notes, tmp_path):
    from collections import Counter

    from tarn import providers
    from tarn.plans import search as plans

    class CountingEmbedder:
        """Counts, in files, how often each text is embedded; fails now and then."""

        name, dims = "counting", 3

        def __init__(self, folder):
            self.folder = folder

        def embed(self, texts):
            import uuid

            with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
                f.write("\n".join(t.replace("\n", " ") for t in texts))
            return [[float(len(t)), 1.0, 2.0] for t in texts]

    os.mkdir(tmp_path / "calls")
    e = Engine(spark, f"{tmp_path}/index", models=plans.Models(CountingEmbedder(str(tmp_path / "calls")), providers.PlainExpander(), providers.OverlapReranker()))
    e.add_collection("notes", str(notes), ignore=["skip/**"])
    e.update()
    n = e.embed()["chunks"]
    seen = Counter(line for f in os.listdir(tmp_path / "calls") for line in (tmp_path / "calls" / f).read_text().split("\n"))
    assert len(seen) == n and set(seen.values()) == {1}
    assert e.tables.read("chunks").count() == e.tables.read("vectors").count() == n


def test_only_changed_documents_are_cut_into_terms(spark, notes, tmp_path, monkeypatch):
    from tarn.operators import segments

    e = Engine(spark, f"{tmp_path}/index")
    e.add_collection("notes", str(notes), ignore=["skip/**"])
    e.update()
    cut, made = [], segments.made

    def counted(docs, gone, *rest):
        cut.append((sorted(r.path for r in docs.collect()), sorted(r.path for r in gone.collect())))
        return made(docs, gone, *rest)

    monkeypatch.setattr(segments, "made", counted)
    (notes / "n2.md").write_text("# Other\nquite other words")
    (notes / "n9.md").write_text("# New\nnewest words")
    os.remove(notes / "n1.md")
    assert e.update()["updated"] == 1
    assert cut == [(["n2.md", "n9.md"], ["n1.md", "n2.md"])]
    found = lambda q: sorted(r.path for r in e.search_lex(q).collect())
    assert found("quite") == ["n2.md"] and found("newest") == ["n9.md"] and found('"noise 1"') == [] and found("databases") == ["sub/b.md"]
    monkeypatch.undo()
    same_as_rebuilt(e, spark, tmp_path / "again")
    (notes / "n3.md").write_text("# Third\nchanged once more")
    before = e.tables.segments()
    e.update()
    assert e.tables.segments()[: len(before)] == before and e.tables.read_segments(e.tables.segments()[-1:])["postings"].count() < 20  # one file's terms
    assert e.update()["unchanged"] and len(e.tables.segments()) == len(before) + 1  # nothing changed, nothing is written
    for k in range(6):
        (notes / f"m{k}.md").write_text(f"# More {k}\nthe words of file {k} and of others")
        if k == 3:
            os.remove(notes / "m1.md")
        e.update()
    assert len(e.tables.segments()) < len(before) + 6  # merged
    same_as_rebuilt(e, spark, tmp_path / "third")


def same_as_rebuilt(e, spark, at):
    """Dictionary, numbers and answers of an index that was updated, against one that is built anew."""
    from tarn.operators import segments
    from tarn.plans.lexquery import parse
    from tarn.sources.snapshots import Warehouse

    docs = e._searched().docs.join(e.tables.read("content").withColumnRenamed("doc", "body").drop("created_at"), "hash")
    w = Warehouse(spark, str(at))
    w.commit(segments=[w.write_segment(1, segments.single(docs, e.analyzer))])
    one, other = e.tables.keyword_index(), w.keyword_index()
    assert sorted(map(tuple, one.dictionary().collect())) == sorted(map(tuple, other.dictionary().collect()))
    assert one.known([])[:2] == other.known([])[:2]
    for q in ("the", "words of", '"words of"', "other -changed", '"noise"', "n"):
        got, want = (sorted((r.doc_id, round(r.score, 9)) for r in x.best(parse(q, e.analyzer), None).collect()) for x in (one, other))
        assert got == want, q


def test_readers_see_whole_commits(spark, tmp_path):
    import threading

    from tarn.sources.snapshots import Warehouse

    w = Warehouse(spark, f"{tmp_path}/w")
    frame = lambda k: spark.createDataFrame([(str(k), "v")], "key string, value string")
    w.commit(config=frame(0))
    stop, seen = threading.Event(), []

    def read():
        while not stop.is_set():
            seen.append([r.key for r in w.read("config").collect()])

    t = threading.Thread(target=read)
    t.start()
    for k in range(1, 6):
        w.commit(config=frame(k))
    stop.set()
    t.join()
    assert all(len(x) == 1 for x in seen) and [int(x[0]) for x in seen] == sorted(int(x[0]) for x in seen)
    number, now = w._current()
    w._publish(number + 1, now)
    with pytest.raises(RuntimeError, match="another writer"):
        w._publish(number + 1, now)
    assert w.vacuum() == 5 and w.read("config").count() == 1


def test_a_racing_commit_fails(spark, tmp_path, monkeypatch):
    """The second of two writers that are after one number can't overwrite the first's pointer, whenever it comes."""
    from tarn.sources.snapshots import UNFINISHED_S, Warehouse

    frame = lambda k: spark.createDataFrame([(str(k), "v")], "key string, value string")
    w, other = (Warehouse(spark, f"{tmp_path}/w") for _ in range(2))
    w.commit(config=frame(0))
    exists = w._fs.exists
    number, now = w._current()

    class Late:  # the other writer comes between this one's look and its creation
        def __getattr__(self, name):
            return getattr(Warehouse(spark, f"{tmp_path}/w")._fs, name)

        def exists(self, path):
            found = exists(path)
            if str(path.getName()) == str(number + 1):
                other.commit(config=frame(1))
            return found

    w._fs = Late()
    with pytest.raises(RuntimeError, match="another writer"):
        w._publish(number + 1, now)
    assert [r.key for r in other.read("config").collect()] == ["1"]
    # a pointer that a writer is just writing doesn't count, and is waited for; one that a dead writer has left is passed over
    at = other._path(f"{tmp_path}/w/pointers/{number + 2}")
    other._fs.create(at, False).close()
    assert [r.key for r in other.read("config").collect()] == ["1"]
    with pytest.raises(RuntimeError, match="another writer"):
        other.commit(config=frame(2))
    other._fs.setTimes(at, other._fs.getFileStatus(at).getModificationTime() - (UNFINISHED_S + 5) * 1000, -1)
    other.commit(config=frame(3))
    assert [r.key for r in other.read("config").collect()] == ["3"]


def test_a_request_reads_one_commit(spark, tmp_path):
    from tarn.sources.snapshots import Warehouse

    frame = lambda k: spark.createDataFrame([(str(k), "v")], "key string, value string")
    w = Warehouse(spark, f"{tmp_path}/w")
    w.commit(config=frame(0))
    one = w.pinned()
    w.commit(config=frame(1))
    assert one.read("config").first().key == "0" and w.read("config").first().key == "1"
