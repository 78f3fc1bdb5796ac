"""Snippets: the lines around a query's best line, with a header of where they are."""

from __future__ import annotations

from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tarn.functions.pieces import by_pieces
from tarn.functions.text import intent_terms
from tarn.operators.chunking import CHARS, CHUNK_TOKENS

#: What an intent's word counts beside a query's (fixed value); text around a chunk that is looked at with it.
INTENT_WEIGHT, AROUND = 0.3, 100

SNIPPET_TYPE = "line int, snippet string, lines_before int, lines_after int, snippet_lines int"
SNIPPET_ARROW = pa.struct([("line", pa.int32()), ("snippet", pa.string()), ("lines_before", pa.int32()), ("lines_after", pa.int32()), ("snippet_lines", pa.int32())])


@dataclass
class Snippet:
    line: int
    snippet: str
    lines_before: int
    lines_after: int
    snippet_lines: int


def snippet(body: str, query: str, most: int = 500, chunk_pos: int | None = None, chunk_len: int | None = None, intent: str | None = None) -> Snippet:
    """The best line with one before and two after it; with ``chunk_pos``, from the region of that chunk, unless the chunk says nothing."""
    region, skipped = body, 0
    if chunk_pos is not None and chunk_pos >= 0:
        first = max(0, chunk_pos - AROUND)
        region = body[first : chunk_pos + (chunk_len or CHUNK_TOKENS * CHARS) + AROUND]
        skipped = body.count("\n", 0, first)
    else:
        chunk_pos = None
    rows = region.split("\n")
    terms = [(t, 1.0) for t in query.lower().split()] + [(t, INTENT_WEIGHT) for t in intent_terms(intent)]
    scores = [sum(w for t, w in terms if t in row.lower()) for row in rows]
    score = max(scores)
    best = scores.index(score)
    if chunk_pos is not None and score <= 0:
        if chunk_pos == 0:
            return snippet(body, query, most, intent=intent)
        best = region.count("\n", 0, chunk_pos - max(0, chunk_pos - AROUND))
    start = max(0, best - 1)
    shown = rows[start : best + 3]
    text = "\n".join(shown)
    if chunk_pos and not text.strip():
        return snippet(body, query, most, intent=intent)
    if len(text) > most:
        text = text[: most - 3] + "..."
    at = skipped + start + 1
    after = body.count("\n") + 1 - (at + len(shown) - 1)
    head = f"@@ -{at},{len(shown)} @@ ({at - 1} before, {after} after)"
    return Snippet(skipped + best + 1, f"{head}\n{text}", at - 1, after, len(shown))


def snippets(body: Column, query: Column, chunk_pos: Column | None = None, most: int = 500, intent: str | None = None) -> Column:
    """The snippet of each row as a struct, some rows at a time."""

    def run(bodies: list, queries: list, places: list) -> list:
        return [asdict(snippet(b or "", q or "", most, p, intent=intent)) for b, q, p in zip(bodies, queries, places)]

    return by_pieces(SNIPPET_TYPE, SNIPPET_ARROW, run)(body, query, chunk_pos if chunk_pos is not None else F.lit(None).cast("int"))
