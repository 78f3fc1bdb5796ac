"""Query documents: typed lines ``lex:``, ``vec:``, ``hyde:``, at most one ``intent:``, or one ``expand:`` (or plain) line alone."""

from __future__ import annotations

import re
from dataclasses import dataclass

from tarn.plans.lexquery import QueryError


@dataclass(frozen=True)
class TypedQuery:
    type: str
    query: str
    line: int | None = None


@dataclass(frozen=True)
class QueryDocument:
    searches: tuple[TypedQuery, ...]
    intent: str | None = None


def parse_query_document(text: str) -> QueryDocument | None:
    """The typed lines of a document; None for a plain query, which is to be expanded."""
    rows = [(n, x.strip()) for n, x in enumerate(text.split("\n"), 1) if x.strip()]
    typed: list[TypedQuery] = []
    intent = None
    for n, row in rows:
        kind, _, rest = (x.strip() for x in row.partition(":"))
        kind = kind.lower() if re.match(r"\w+:", row) else ""
        if kind == "expand":
            if len(rows) > 1:
                raise QueryError(f"line {n}: expand: stands alone")
            if not rest:
                raise QueryError("expand: needs text")
            return None
        if kind == "intent":
            if intent is not None:
                raise QueryError(f"line {n}: a second intent:")
            if not rest:
                raise QueryError(f"line {n}: intent: needs text")
            intent = rest
        elif kind in ("lex", "vec", "hyde"):
            if not rest:
                raise QueryError(f"line {n}: {kind}: needs text")
            if "\r" in rest:
                raise QueryError(f"line {n}: {kind}: holds a line end")
            typed.append(TypedQuery(kind, rest, n))
        elif len(rows) == 1:
            return None
        else:
            raise QueryError(f"line {n}: lex:, vec:, hyde: or intent: is missing")
    if intent and not typed:
        raise QueryError("intent: needs a lex:, vec: or hyde: line beside it")
    return QueryDocument(tuple(typed), intent) if typed else None


def plain_text(text: str) -> str:
    """A plain query without its ``expand:``."""
    return re.sub(r"^\s*expand:\s*", "", text, flags=re.IGNORECASE).strip()
