"""Token counts by the whole-token shortcut.

Offline, on the driver, every vocabulary string is encoded by the library, and
those that come out alone as one token are proved to be whole tokens. On the
executors a text's strings that match one count 1 without the tokenizer; only
the rest are pre-tokenized and merged, a string once for as long as a worker's
table holds it.

The shortcut is for word-level files (``wordpieces.by_strings``); with any other
tokenizer file the library counts whole texts. A very long text is counted whole.
Null and empty texts have 0 bytes and 0 tokens. Special strings inside a text
are handled as the library does by default. Extra columns are ignored; repeated
rows give repeated results, rows without a doc_id theirs; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tarn.llm.shared import map_units, pick
from tarn.llm.wordpieces import Whole, WordTable, by_strings, whole_tokens

_TABLES: dict[str, WordTable | Whole] = {}


def _table(tokenizer: str, proven: dict[bytes, int] | None) -> WordTable | Whole:
    """This worker's table; it outlives tasks."""
    if tokenizer not in _TABLES:
        _TABLES[tokenizer] = Whole(tokenizer) if proven is None else WordTable(tokenizer, proven)
    return _TABLES[tokenizer]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) of every document."""
    proven = docs.sparkSession.sparkContext.broadcast(whole_tokens(tokenizer) if by_strings(tokenizer) else None)  # at most the vocabulary

    def work(rest, texts):
        n = _table(tokenizer, proven.value).values(texts)
        return {"doc_id": rest["doc_id"], "n_bytes": [len(t) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return map_units(pick(docs, "doc_id", "text"), "doc_id long, n_bytes long, n_tokens long, over_limit boolean", work)
