"""Model providers: what embeds, expands and reranks.

The defaults are deterministic stand-ins that need no model; their results say
nothing of a model's quality. A provider is pickled to the executors and loads
what it needs there.
"""

from __future__ import annotations

import hashlib
import re
from typing import Protocol

import numpy as np


class Embedder(Protocol):
    name: str
    dims: int

    def embed(self, texts: list[str]) -> list[list[float] | None]: ...


class Expander(Protocol):
    name: str

    def expand(self, query: str) -> list[tuple[str, str]]: ...


class Reranker(Protocol):
    name: str

    def rerank(self, query: str, texts: list[str]) -> list[float]: ...


class HashEmbedder:
    """Words hashed to signed dimensions, unit length."""

    name = "hashed-words"

    def __init__(self, dims: int = 64):
        self.dims = dims

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        out = []
        for t in texts:
            v = np.zeros(self.dims)
            for w in re.findall(r"\w+", (t or "").lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % self.dims] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out


class PlainExpander:
    """A fixed triple: a passage that names the query, its words, the query as it is."""

    name = "plain"

    def expand(self, query: str) -> list[tuple[str, str]]:
        return [("hyde", f"Information about {query}"), ("lex", query), ("vec", query)]


class OverlapReranker:
    """The share of the query's words that a text holds."""

    name = "overlap"

    def rerank(self, query: str, texts: list[str]) -> list[float]:
        words = set(re.findall(r"\w+", query.lower()))
        return [len(words & set(re.findall(r"\w+", (t or "").lower()))) / max(1, len(words)) for t in texts]


def query_prompt(query: str, model: str) -> str:
    """A query as an embedding model of its family wants it."""
    if "qwen" in model.lower() and "embed" in model.lower():
        return f"Instruct: Retrieve relevant documents for the given query\nQuery: {query}"
    return f"task: search result | query: {query}"


def document_prompt(text: str, title: str | None, model: str) -> str:
    if "qwen" in model.lower() and "embed" in model.lower():
        return f"{title}\n{text}" if title else text
    return f"title: {title or 'none'} | text: {text}"


def fingerprint(model: str) -> str:
    """Six digits that change with the model, its prompts and the chunk sizes."""
    from tarn.operators.chunking import CHUNK_TOKENS, OVERLAP_TOKENS

    parts = [model, query_prompt("probe", model), document_prompt("probe", "probe title", model), str(CHUNK_TOKENS), str(OVERLAP_TOKENS)]
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:6]


def cache_key(kind: str, *parts: str) -> str:
    return hashlib.sha256("\x1f".join([kind, *parts]).encode()).hexdigest()
