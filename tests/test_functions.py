import re

import pytest
from pyspark.sql import functions as F

from tarn.functions import paths as P
from tarn.functions import text as T
from tarn.functions.analyzer import folded, stem, term


@pytest.fixture(scope="module")
def one(spark):
    def value(column):
        return spark.range(1).select(column.alias("v")).first()[0]

    return value


@pytest.mark.parametrize("glob,path,matches", [
    ("**/*.md", "a/b.md", True), ("**/*.md", "b.md", True), ("*.md", "a/b.md", False), ("src/**", "src/a/b", True), ("*.{md,txt}", "a.txt", True),
    ("**/*.md", ".x/b.md", False), ("a?c", "abc", True), ("[ab]*.md", "b1.md", True), ("[!ab]*.md", "b1.md", False), ("docs/**/x.md", "docs/x.md", True), ("docs/**/x.md", "docs/p/q/x.md", True),
])
def test_globs(one, glob, path, matches):
    assert bool(re.match(P.glob_regex(glob), path)) == matches
    assert one(F.lit(path).rlike(P.glob_regex(glob))) == matches


def test_masks():
    assert P.split_globs("a/*.md, b/{c,d}.md,[x,y].md,,") == ["a/*.md", "b/{c,d}.md", "[x,y].md"]
    assert P.split_globs("") == [""]


def test_slugs():
    assert P.slug_of("A B/c___d🐘.test file.MD") == "A-B/c/d1f418-test-file.MD"
    assert P.slug_of("a/$route.ts") == "a/$route.ts" and P.slug_of("--/!!") is None
    assert P.slug_of("naïve (copy).md") == "naïve-copy.md"


def test_docids(one):
    assert P.parse_docid(' "#AbC123" ') == "AbC123" and P.parse_docid("abc12") is None and P.parse_docid("xyz123") is None
    assert one(P.normalized_docid(F.lit("'#abc123'"))) == "abc123"
    assert one(P.is_docid(F.lit("#abc123"))) and not one(P.is_docid(F.lit("abc")))


def test_virtual_paths(one):
    for x in ("tarn://c/a/b.md", "tarn:////c/a/b.md", "//c/a/b.md", "tarn://c/a/b.md?index=x", "tarn:c/a/b.md"):
        assert P.parse_virtual_path(x) == ("c", "a/b.md"), x
    assert P.parse_virtual_path("c/a.md") is None
    assert one(P.virtual_path(F.lit("c"), F.lit("a b.md"))) == "tarn://c/a b.md"
    assert one(P.encoded_path(F.lit("a b/ü+.md"))) == "a%20b/%C3%BC%2B.md"
    assert one(P.encoded_path(F.lit("it's (a)~!*/&.md"))) == "it's%20(a)~!*/%26.md"


def test_paths(one):
    assert one(P.relative_to(F.lit("/r/a\\b"), F.lit("/r/"))) == "a/b" and one(P.relative_to(F.lit("/rr/a"), F.lit("/r"))) is None
    assert P.inside("/r/../r/a", "/r") and not P.inside("/r/../x", "/r") and not P.inside("/rr", "/r")
    for p, yes in (("/a", True), ("C:\\x", True), ("~/a", True), ("a/b", False)):
        assert one(P.is_absolute(F.lit(p))) == yes
    assert one(P.same_file(F.lit("tarn://c/docs/A.md"), F.lit("docs/a.md"))) and one(P.same_file(F.lit("a.md"), F.lit("x/a.md"))) and not one(P.same_file(F.lit("b.md"), F.lit("a.md")))
    assert one(P.language_of(F.lit("a/b.tsx"))) == "tsx" and one(P.language_of(F.lit("a.md"))) is None
    assert one(P.valid_collection_name(F.lit("a_b-1"))) and not one(P.valid_collection_name(F.lit("a b")))


@pytest.mark.parametrize("doc,path,title", [
    ("# One\n## Two", "a.md", "One"), ("text\n## Two\n", "a.md", "Two"), ("# Notes\n## Real\n", "a.md", "Real"), ("# 📝 Notes\nx", "a.md", "📝 Notes"), ("### three", "d/a.b.md", "a.b"),
    ("#+TITLE: Org one\n* head", "a.org", "Org one"), ("* head\n", "a.ORG", "head"), ("# no", "a.txt", "a"), ("", ".md", ".md"),
])
def test_titles(one, doc, path, title):
    assert one(T.title(F.lit(doc), F.lit(path))) == title


def test_lines(one):
    doc = F.lit("a\nb\nc\nd")
    assert one(T.line_slice(doc, 2, 2)) == "b\nc" and one(T.line_slice(doc, 0, 0)) == "a" and one(T.line_slice(doc, 3)) == "c\nd"
    assert one(T.numbered(doc, 5)) == "5: a\n6: b\n7: c\n8: d"
    assert one(T.clipped(doc, 2)) == "a\nb\n\n[... truncated 2 more lines]" and one(T.clipped(doc, 4)) == "a\nb\nc\nd"
    assert one(T.best_line(F.lit("x\nfoo\nfoo bar\nbar foo"), ["foo", "bar"])) == 3
    assert one(T.highlighted(F.lit("The Cat"), ["cat", "at"])) == "The **Cat**"


def test_readable(one):
    at = lambda s: F.timestamp_seconds(F.lit(s))
    assert [one(T.time_ago(at(0), at(s))) for s in (5, 61, 7200, 200_000)] == ["5s ago", "1m ago", "2h ago", "2d ago"]
    assert one(T.days_since(at(0), at(86400 * 3 + 5))) == 3
    assert [one(T.readable_bytes(F.lit(n))) for n in (5, 1536, 3 << 20)] == ["5 B", "1.5 KB", "3.0 MB"]
    assert [one(T.readable_ms(F.lit(n))) for n in (250, 1500)] == ["250ms", "1.5s"] and [one(T.readable_eta(F.lit(n))) for n in (45, 59.4, 59.6, 200.5, 3900)] == ["45s", "59s", "60s", "3m 21s", "1h 5m"]
    assert one(T.csv_field(F.lit('a"b'))) == '"a""b"' and one(T.csv_field(F.lit(None))) == "" and one(T.xml_text(F.lit("<a & 'b'>"))) == "&lt;a &amp; &apos;b&apos;&gt;"


def test_days_of_moments_ahead(one):
    at = lambda s: F.timestamp_seconds(F.lit(s))
    day = 86400
    assert [one(T.whole_days_since(at(10 * day), at(s))) for s in (10 * day, 10 * day - 1, 9 * day + 1, 9 * day, 8 * day + 5, 11 * day, 12 * day - 1)] == [0, 0, 0, -1, -1, 1, 1]
    assert one(T.days_since(at(10 * day), at(10 * day - 1))) == -1


def test_cjk(one):
    assert one(T.spaced_cjk(F.lit("a検b"))) == "a 検 b"
    assert one(T.tokens(F.lit("検索ABC テスト"))) == ["検", "索", "abc", "テ", "ス", "ト"]
    assert one(T.contains_cjk(F.lit("a検"))) and not one(T.contains_cjk(F.lit("abc")))


def test_intent_terms():
    assert T.intent_terms("Looking for the API, (SQL) and LLM-notes about x") == ["api", "sql", "llm-notes"]
    assert T.intent_terms(None) == []


def test_stems_are_those_of_another_implementation():
    import sqlite3

    words = "relational conditional rational valenci digitizer conformabli radicalli vietnamization operator feudalism decisiveness hopefulness formaliti triplicate formative electrical goodness revival allowance inference airliner adjustable defensible irritant replacement adjustment adoption communism effective bowdlerize probate rate cease controll roll caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky running university universities archaeology uber naiv".split()
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(x, tokenize='porter unicode61')")
    db.execute("create virtual table v using fts5vocab(t, 'instance')")
    db.executemany("insert into t(rowid, x) values (?, ?)", list(enumerate(words, 1)))
    other = dict(db.execute("select doc, term from v").fetchall())
    assert [stem(w) for w in words] == [other[k] for k in range(1, len(words) + 1)]
    assert folded("Über") == "Uber" and term("Naïve", "porter") == "naiv" and term("Über", "simple") == "über"


def test_column_forms_agree(spark):
    from tarn.operators import lookup
    from tarn.plans import lexquery

    def passes(check, x):
        try:
            check(x)
        except lexquery.QueryError:
            return False
        return True

    texts = ["", " ", "What is (the) API-key, für C++?", "a.md", "a.md:3", "a.md:3:4", "a:b:0", ":5", "tarn://c/p/q.md", "//c/p", "///c", "tarn:c/p?index=x", "tarn:", "//", " tarn://c/ ", "c/p", 'say "x', 'x -"y"', "a\n-b", "re-use", "　-é", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    t = F.col("t")
    got = df.select("k", T.intent_words(t).alias("w"), P.virtual_parts(t).alias("v"), lookup.line_range_of(t).alias("r"), lexquery.valid_lex(t).alias("x"), lexquery.valid_semantic(t).alias("s"), T.line_range(t, F.lit(None).cast("int"), F.lit(None).cast("int")).alias("all"))
    for row in got.collect():
        x = texts[row.k]
        assert row.w == T.intent_terms(x) and row["all"] == x
        if x is None:
            assert row.v is None and row.x is None and row.s is None
            continue
        assert (tuple(row.v) if row.v else None) == P.parse_virtual_path(x), x
        assert not x or tuple(row.r) == lookup.split_range(x), x
        assert row.x == passes(lexquery.validate_lex, x) and row.s == passes(lexquery.validate_semantic, x), x
