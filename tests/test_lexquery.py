import pytest

from tarn.plans.lexquery import LexPlan, Phrase, QueryError, parse, validate_lex, validate_semantic
from tarn.plans.querydoc import parse_query_document, plain_text


def p(*tokens, prefix=False):
    return Phrase(tokens, prefix)


@pytest.mark.parametrize("text,positive,negative", [
    ("performance -sports", [p("performance", prefix=True)], [[p("sports", prefix=True)]]),
    ('"machine learning"', [p("machine", "learning")], []),
    ("multi-agent memory", [p("multi", "agent"), p("memory", prefix=True)], []),
    ("DEC-0054", [p("dec", "0054")], []),
    ("x -multi-agent", [p("x", prefix=True)], [[p("multi", "agent")]]),
    ("2026.4.10", [p("2026", prefix=True), p("4", prefix=True), p("10", prefix=True)], []),
    ("x -3.14", [p("x", prefix=True)], [[p("3", prefix=True), p("14", prefix=True)]]),
    ("検索 word", [p("検", "索"), p("word", prefix=True)], []),
    ('say "a b" -"c d"', [p("say", prefix=True), p("a", "b")], [[p("c", "d")]]),
    ("foo_bar don't", [p("foo", "bar", prefix=True), p("don", "t", prefix=True)], []),
    ('open "quote here', [p("open", prefix=True), p("quote", "here")], []),
])
def test_parse(text, positive, negative):
    assert parse(text) == LexPlan(positive, negative)


@pytest.mark.parametrize("text", ["", "  ", "-only", '""', "!!!", "- -"])
def test_nothing_to_search(text):
    assert parse(text) is None


def test_stemmed():
    assert parse("Running", "porter").positive == [p("run", prefix=True)]


def test_validation():
    validate_lex('a "b"')
    validate_semantic("real-time write-ahead")
    for bad in ("a\nb", 'a "b'):
        with pytest.raises(QueryError):
            validate_lex(bad)
    for bad in ("-no", 'a -"b"'):
        with pytest.raises(QueryError):
            validate_semantic(bad)


def test_query_documents():
    d = parse_query_document("LEX: a b\n\nvec: what is c\nintent: notes\nhyde: a passage")
    assert [(q.type, q.query, q.line) for q in d.searches] == [("lex", "a b", 1), ("vec", "what is c", 3), ("hyde", "a passage", 5)] and d.intent == "notes"
    assert parse_query_document("plain words") is None and parse_query_document("") is None and parse_query_document("expand: some") is None
    assert plain_text("Expand:  some words") == "some words"
    for bad in ("expand: a\nlex: b", "expand:", "lex:", "lex: a\nplain", "intent: a", "intent: a\nintent: b\nlex: c", "intent:\nlex: a"):
        with pytest.raises(QueryError):
            parse_query_document(bad)
