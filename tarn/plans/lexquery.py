"""The keyword query language.

``word`` matches as a prefix, ``"some words"`` as a phrase, ``-`` before either
excludes. ``multi-part`` words are phrases, ``1.2.3`` stands for all of its parts,
words with CJK characters are phrases of these. Everything positive must occur.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from tarn.functions.analyzer import term

_ITEM = regex.compile(r'(?P<no>-?)(?:"(?P<phrase>[^"]*)"?|(?P<word>[^\s"]+))|-')
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]")
_TOKEN = regex.compile(r"[\p{L}\p{N}]+")
_HYPHENATED = regex.compile(r"[\p{L}\p{N}][\p{L}\p{N}'-]*-[\p{L}\p{N}][\p{L}\p{N}'-]*")
_DOTTED = regex.compile(r"[\p{L}\p{N}_]+(?:\.[\p{L}\p{N}_]+)+")


@dataclass(frozen=True)
class Phrase:
    """Terms in a row; the last one may be a prefix."""

    tokens: tuple[str, ...]
    prefix: bool = False


@dataclass
class LexPlan:
    """Phrases that must occur, and groups of phrases that must not occur together."""

    positive: list[Phrase] = field(default_factory=list)
    negative: list[list[Phrase]] = field(default_factory=list)


class QueryError(ValueError):
    """A query that breaks the rules of its language."""


def validate_lex(query: str) -> None:
    if "\n" in query or "\r" in query:
        raise QueryError("a lex query is a single line")
    if query.count('"') % 2:
        raise QueryError("a lex query has an unmatched double quote")


def validate_semantic(query: str) -> None:
    """vec and hyde queries know no exclusion; a hyphen inside a word is none."""
    if regex.search(r'(^|\s)-[\w"]', query):
        raise QueryError("exclusion (-term) is for lex queries only")


def valid_lex(query: Column) -> Column:
    """Whether ``validate_lex`` would let a column's queries pass."""
    return ~query.rlike(r"[\n\r]") & (F.length(F.regexp_replace(query, '[^"]', "")) % 2 == 0)


def valid_semantic(query: Column) -> Column:
    """Whether ``validate_semantic`` would let a column's queries pass."""
    return ~query.rlike(r'(?U)(^|\s)-[\w"]')


def spaced(text: str) -> str:
    return _CJK.sub(r" \g<0> ", text)


def _phrase(text: str, analyzer: str, prefix: bool = False) -> list[Phrase]:
    tokens = tuple(term(t, analyzer) for t in _TOKEN.findall(spaced(text).lower()))
    return [Phrase(tokens, prefix)] if tokens else []


def _bare(word: str) -> str:
    """Letters, digits, apostrophes and underscores; the analyzer splits at the latter two."""
    return regex.sub(r"[^\p{L}\p{N}'_]", "", word)


def parse(query: str, analyzer: str = "simple") -> LexPlan | None:
    """The plan of a query; None where nothing positive is left to search."""
    plan = LexPlan()
    for m in _ITEM.finditer(query.strip()):
        word, phrase = m["word"], m["phrase"]
        if phrase is not None:
            found = _phrase(phrase, analyzer)
        elif word is None:
            continue
        elif _HYPHENATED.fullmatch(word):
            found = _phrase(word.replace("-", " "), analyzer)
        elif _DOTTED.fullmatch(word):
            found = [p for part in word.split(".") for p in _phrase(_bare(part), analyzer, prefix=True)]
        elif _CJK.search(word):
            found = _phrase(word, analyzer)
        else:
            found = _phrase(_bare(word), analyzer, prefix=True)
        if not found:
            continue
        if m["no"]:
            plan.negative.append(found)
        else:
            plan.positive += found
    return plan if plan.positive else None
