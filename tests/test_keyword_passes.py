"""Counts of a keyword index without its lists; stems of the words that matter only."""

from tarn.functions.analyzer import certain, stem
from tarn.operators import bm25
from tarn.plans.lexquery import parse

TEXTS = ["Licensing versions of ability", "abilities and LICENSES versión", "lìcense vérsions only", "nothing here", "possibilities version2 licence", None, "license " * 30]


def frame(spark):
    rows = [(k, "c", f"p{k}.md", f"t {k}", x) for k, x in enumerate(TEXTS)] + [(0, "c", "p0.md", "again", "ability license")]
    return spark.createDataFrame(rows, "doc_id long, collection string, path string, title string, body string")


def test_counts_need_no_lists(spark):
    index = bm25.Postings.build(frame(spark))
    lean = index.dictionary()
    assert "collect_list" not in lean._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, lean.collect())) == sorted(map(tuple, bm25.Postings(index.postings, index.doc_lengths).dictionary().collect()))


def test_only_words_that_can_have_a_stem_are_stemmed(spark):
    docs = frame(spark).where("title <> 'again'")
    scan, index = bm25.Scan(docs, "porter"), bm25.Postings.build(docs, "porter")
    for text in ("licensing versions", "ability", "possib license", '"licensing versions"', "license -abilities"):
        plan = parse(text, "porter")
        get = lambda x: sorted((r.doc_id, round(r.score, 9)) for r in bm25.matches(x, plan).collect())  # noqa: E731, B023
        assert get(scan) == get(index)
    phrases = parse("licensing versions", "porter").positive
    kept = scan._terms(docs["body"], phrases)
    assert [len(r[0]) for r in docs.orderBy("doc_id").select(kept).collect()] == [2, 2, 2, 0, 2, 0, 30]
    assert all(w.startswith(certain(stem(w))) for w in "abilities ability relational flies hopping digitizer sensibiliti agreed".split())
