"""Benchmark decontamination by an FM-index of each shard of the training text.

Words of benchmark items get small numbers. A unit of documents is a shard: of
its words only maximal runs of benchmark words that are long enough to hold a
window enter its index, which loses no occurrence, since a window consists of
benchmark words. All windows are then searched backwards at once through the
wavelet matrix, their occurrences located by the sampled suffix positions, and
the occurrences merged into removal spans.

A window is ``window`` consecutive words of an item; an item of fewer words, but
not none, is one window. The benchmark is read in blocks of about ``BLOCK_BYTES``
of text, each of them broadcast: what is broadcast at once doesn't grow with it.

Null and empty texts have no words and are clean; null item texts have no
windows. Items of equal text each count. Repeated documents are judged each.
Empty tables give no rows, or clean documents. Extra columns are ignored. A row
without a doc_id is judged like any other. A very long text is one shard, indexed and
searched whole by one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.fm_index import FMIndex, ranges
from tarn.llm.shared import arrow_schema, batch, filter_units, pick, ship, units
from tarn.llm.words import Vocabulary, Words, runs, words_of

#: Benchmark text searched at once.
BLOCK_BYTES = 4 << 20
KIND = "alnum_lower"


class Phrases:
    """The windows of a block of items: by length, distinct, with the items that hold each."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        items = sorted(items, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
        w = words_of([t for _, t in items], KIND)
        self.vocabulary = Vocabulary(w.hash)
        ids = self.vocabulary.ids(w.hash)
        found: dict[int, dict[tuple, set]] = {}
        for (item, _), a, b in zip(items, w.bounds[:-1], w.bounds[1:]):
            n = min(window, b - a)
            for i in range(a, b - n + 1) if n else ():
                named = found.setdefault(int(n), {}).setdefault(tuple(ids[i : i + n].tolist()), set())
                if item is not None:  # an item without an id is looked for, but has nothing to be counted or named by
                    named.add(item)
        self.groups = [(n, np.array(list(g), np.int32), [sorted(s) for s in g.values()]) for n, g in sorted(found.items())]
        self.least = min(found, default=0)

    def find(self, w: Words) -> tuple[np.ndarray, np.ndarray, list[tuple[int, str]]]:
        """First and end word of every occurrence, and the distinct (document, item) pairs."""
        none = np.zeros(0, np.int64)
        if not self.groups:
            return none, none, []
        ids = self.vocabulary.ids(w.hash)
        first, end = runs(ids, w.bounds, self.least)
        if not len(first):
            return none, none, []
        segment, place = ranges(first, end + 1)  # one more for the terminator
        last = np.cumsum(end - first + 1) - 1
        text = ids[np.minimum(place, len(ids) - 1)]
        text[last] = 0
        index = FMIndex(text, len(self.vocabulary))
        starts, ends, pairs = [], [], set()
        for n, patterns, holders in self.groups:
            lo, hi = index.search(patterns)
            which, rows = ranges(lo, hi)
            if not len(rows):
                continue
            at = place[index.locate(rows)]
            starts.append(at)
            ends.append(at + n)
            doc = np.searchsorted(w.bounds, at, "right") - 1
            for d, k in set(zip(doc.tolist(), which.tolist())):
                pairs.update((d, item) for item in holders[k])
        if not starts:
            return none, none, []
        return np.concatenate(starts), np.concatenate(ends), sorted(pairs)


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans with those that overlap joined; spans of different documents never do."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    s, e = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], s[1:] >= e[:-1]))
    return s[new], e[np.concatenate((new[1:], [True]))]


def blocks(benchmark: DataFrame) -> list[DataFrame]:
    """The items in blocks of about BLOCK_BYTES of text."""
    items = benchmark.select(F.col("`item_id`").cast("string").alias("item_id"), F.col("`text`").alias("text")).where("text IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // BLOCK_BYTES))
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, text, spans (int64 pairs of word numbers, as bytes), items (those that occur) of every document."""
    spark = docs.sparkSession
    ship(spark)
    kinds = "doc_id long, text string, spans binary, items array<string>"
    schema = arrow_schema(kinds)
    frame = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(None).cast("binary").alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    for block in blocks(benchmark):
        shared = spark.sparkContext.broadcast(Phrases([(r[0], r[1].encode()) for r in block.collect()], window))  # one block

        def run(batches, shared=shared):
            for rest, texts in units(_kept(batches)):
                w = words_of(texts, KIND)
                start, end, pairs = shared.value.find(w)
                start, end = merged(start, end)
                cut = np.searchsorted(start, w.bounds)
                items: dict[int, list[str]] = {}
                for d, item in pairs:
                    items.setdefault(d, []).append(item)
                spans, found = [], []
                for d, (old, had) in enumerate(zip(rest["spans"], rest["items"])):
                    own = np.stack((start[cut[d] : cut[d + 1]], end[cut[d] : cut[d + 1]]), 1) - w.bounds[d]
                    if old:
                        own = np.stack(merged(*np.concatenate((np.frombuffer(old, np.int64).reshape(-1, 2), own)).T), 1)
                    spans.append(own.astype(np.int64).tobytes())
                    found.append(sorted({*(had or []), *items.get(d, [])}))
                yield batch(schema, {"doc_id": rest["doc_id"], "text": rest["raw"], "spans": spans, "items": found})

        frame = frame.mapInArrow(run, kinds)
    return frame


def _kept(batches):
    """The text once more under another name, so that it comes out as it went in."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, b.column(b.schema.get_field_index("text"))], names=[*b.schema.names, "raw"])


def leak_report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document.

    item_id may be of any type that has a string form, which names the item; items
    without one are looked for, so their words are hit, but they are neither counted nor
    named. Texts of any length are searched whole, each by one task.
    """
    ddl = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    schema = arrow_schema(ddl)

    def run(batches):
        for rest, texts in units(batches):
            hit = [int(np.diff(np.frombuffer(s, np.int64).reshape(-1, 2)).sum()) for s in rest["spans"]]
            named = [",".join(sorted(i)) for i in rest["items"]]
            yield batch(schema, {
                "doc_id": rest["doc_id"], "n_words": words_of(texts, KIND).counts(), "n_hit": hit, "n_items": [len(i) for i in rest["items"]],
                "items_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in named], "contaminated": [h > 0 for h in hit],
            })

    return find_leaks(docs, benchmark, window).mapInArrow(run, ddl)


def cleaned(text: bytes, spans: np.ndarray) -> bytes:
    """The text without the bytes from the first word to the last of each span."""
    w = words_of([text], KIND)
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : w.start[a]])
        at = int(w.end[b - 1])
    return b"".join([*out, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id and text, the removal spans cut out; clean texts are unchanged and null stays null."""
    ddl = "doc_id long, text string"
    schema = arrow_schema(ddl)

    def run(batches):
        for rest, texts in units(_kept(batches)):
            out = [r if not s else cleaned(t, np.frombuffer(s, np.int64).reshape(-1, 2)).decode() for t, s, r in zip(texts, rest["spans"], rest["raw"])]
            yield batch(schema, {"doc_id": rest["doc_id"], "text": out})

    return find_leaks(docs, benchmark, window).mapInArrow(run, ddl)


def without_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents in which no window occurs, all columns as they are."""
    for block in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(Phrases([(r[0], r[1].encode()) for r in block.collect()], window))  # one block

        def keep(texts, shared=shared):
            w = words_of(texts, KIND)
            found = np.zeros(len(texts), bool)
            found[np.searchsorted(w.bounds, shared.value.find(w)[0], "right") - 1] = True
            return ~found

        docs = filter_units(docs, keep)
    return docs
