"""A keyword index in immutable segments.

A segment holds what one commit added and took away:

* ``postings``: blocks of at most BLOCK documents of a term (the best ones together),
  with the best f / (f + d) in the block (f the weighted frequency, d BM25's length
  term for the mean length of then), from which an upper bound of its scores follows
  whatever the mean length is by now;
* ``dictionary``: how many documents and places of a term came, less those that went,
  and the bounds of all its blocks;
* ``totals``: documents and tokens, and the words whose pairs are indexed;
* ``marks``: documents of earlier segments that are gone (or come again in this one).

An update of one file writes one small segment, however large the index is. Merges
are size-tiered: when enough segments in a row are of about the same size they become
one. Statistics are read from a few rows of the dictionary, never from postings, but
where a phrase's or a prefix's own number of documents is wanted.

A pair of words that are both in most documents is a term of its own, so a phrase of
such words doesn't read their postings. A plan of exact words first scores what the
best blocks of its words share; a block of a word whose bound, with the most that the
other words can give, stays below the kth score found isn't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.analyzer import terms
from tarn.operators.bm25 import B, FIELD, K1, LEAST_IDF, WEIGHTS, Statistics, _all, _any, _texts, moved
from tarn.plans.lexquery import LexPlan, Phrase

#: Documents of a block. Words in this share of documents get pairs (PAIRED at most), judged by one document in SAMPLED.
BLOCK, SHARE, PAIRED, SAMPLED = 512, 0.25, 64, 16
#: Places that are in Python at once; terms in this share of a task's documents are dealt to so many tasks.
PIECE, OFTEN, SALTS = 1 << 20, 1 / 16, 64
#: What a shuffled row has of a document; a place there is its number in the field times 4, plus the field's.
_DOCUMENT = np.dtype([("doc", "<i8"), ("dl", "<i4"), ("count", "<i4")])
#: So many segments of a tier are merged; a tier's segments are at most so many times as large as the smallest.
FAN, TIER = 4, 4
#: Blocks of each word that are scored for a threshold, and from how many blocks on it pays.
FIRST_BLOCKS, WORTH = 4, 16

SCHEMAS = {
    "postings": "term string, n int, cf long, top double, mean double, doc_ids array<long>, dls array<int>, fs array<double>, places array<array<long>>, segment int",
    "dictionary": "term string, df long, cf long, top double, mean double, segment int",
    "totals": "n long, tokens long, paired array<string>, segment int",
    "marks": "doc_id long, segment int",
}
_INVERTED_DDL = "term string, salt int, docs binary, places binary"
_BLOCK_DDL = "term string, n int, cf long, top double, mean double, doc_ids array<long>, dls array<int>, fs array<double>, places array<array<long>>"


def paired_words(docs: DataFrame, analyzer: str) -> list[str]:
    """The words that at least SHARE of a sample of documents hold: they steer cost, not results."""
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0)
    words = some.select(F.explode(F.array_distinct(terms(F.col("body"), analyzer))).alias("w")).groupBy("w").count()
    rows, n = words.orderBy(F.desc("count"), "w").limit(PAIRED).collect(), some.count()
    return sorted(r["w"] for r in rows if r["count"] >= SHARE * n)


def _binary(values: np.ndarray, heads: np.ndarray) -> pa.Array:
    """Values in rows that begin at ``heads``."""
    edges = (np.append(heads, len(values)) * values.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(values).view(np.uint8))])


def _values(rows: pa.ChunkedArray, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The values of all rows of a binary column, and how many each row has."""
    x = rows.combine_chunks()
    edges = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1]
    return np.frombuffer(x.buffers()[2], np.uint8)[edges[0] : edges[-1]].view(kind), np.diff(edges) // kind.itemsize


def _documents(doc: np.ndarray, dl: np.ndarray, count: np.ndarray) -> np.ndarray:
    out = np.empty(len(doc), _DOCUMENT)
    out["doc"], out["dl"], out["count"] = doc, dl, count
    return out


def _salts(doc_ids: np.ndarray) -> np.ndarray:
    """The upper bits of a hash: numbers in a row get several."""
    return ((doc_ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) * SALTS >> 32


def _sorted_terms(doc_ids: np.ndarray, fields: list[pa.ListArray], paired: list[str]) -> pa.RecordBatch:
    """The terms of some documents (``fields``: a list of words of each document, by field), and pairs of paired words: a row a term."""
    sizes = [f.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for f in fields]
    flat = pa.concat_arrays([f.flatten() for f in fields]).dictionary_encode()
    n, n_words = len(doc_ids), len(flat.dictionary)
    code = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.concatenate([np.repeat(np.arange(n), x) for x in sizes])
    place = np.concatenate([k + 4 * (np.arange(x.sum()) - np.repeat(np.cumsum(x) - x, x)) for k, x in enumerate(sizes)])
    dl = sum(sizes).astype(np.int32)
    if paired and len(code) > 1:
        own = pc.fill_null(pc.index_in(flat.dictionary, pa.array(paired, pa.string())), -1).to_numpy(zero_copy_only=False).astype(np.int64)[code]
        at = np.flatnonzero((own[:-1] >= 0) & (own[1:] >= 0) & (doc[1:] == doc[:-1]) & (place[1:] == place[:-1] + 4))
        code = np.concatenate([code, n_words + own[at] * len(paired) + own[at + 1]])
        doc, place = np.concatenate([doc, doc[at]]), np.concatenate([place, place[at]])
    # by term, document and place: within a term and a document places are in order as they stand
    size = max(1, len(code))
    order = np.sort((code * n + doc) * size + np.arange(len(code))) % size
    code, doc, place = code[order], doc[order], place[order]
    new_term = np.append(True, code[1:] != code[:-1])[: len(code)]
    first = np.flatnonzero(new_term | np.append(True, doc[1:] != doc[:-1])[: len(code)])  # of a document's places of a term
    heads = np.flatnonzero(new_term[first])  # of a term's documents
    term = code[first[heads]]
    pairs = [f"{paired[a]} {paired[b]}" for a, b in zip(*(x.tolist() for x in np.divmod(term[term >= n_words] - n_words, max(1, len(paired)))))]
    names = pa.concat_arrays([flat.dictionary.take(pa.array(term[term < n_words])), pa.array(pairs, pa.string())])
    often = np.diff(np.append(heads, len(first))) >= OFTEN * n
    salt = np.where(often, _salts(doc_ids[:1]), 0).astype(np.int32)
    found = _documents(doc_ids[doc[first]], dl[doc[first]], np.diff(np.append(first, len(code))))
    return pa.RecordBatch.from_arrays([names, pa.array(salt), _binary(found, heads), _binary(place.astype(np.int32), first[heads])], names=["term", "salt", "docs", "places"])


def inverted(docs: DataFrame, analyzer: str, paired: list[str]) -> DataFrame:
    """term, salt, docs, places: the documents of a term among some thousands that a task reads one after the other, with their lengths and how many places each has, and all the places. What frequent terms have is dealt out by its salt."""
    arrays, piece = docs.select("doc_id", *(terms(x, analyzer).alias(f) for f, x in _texts().items())), PIECE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fields = [b.column(f) for f in WEIGHTS]
            ends = np.cumsum(sum(f.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for f in fields))
            at = 0
            while at < b.num_rows:  # a document is always whole
                to = max(at + 1, int(np.searchsorted(ends, piece + (ends[at - 1] if at else 0), "right")))
                yield _sorted_terms(b.column("doc_id")[at:to].to_numpy(), [f[at:to] for f in fields], paired)
                at = to

    return arrays.mapInArrow(run, _INVERTED_DDL)


def _repacked(rows: DataFrame) -> DataFrame:
    """Rows of a term and a document (term, doc_id, dl, places) as ``inverted`` has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, dl = (b.column(c).to_numpy() for c in ("doc_id", "dl"))
            count, place = b.column("places").value_lengths().to_numpy(), b.column("places").flatten().to_numpy()
            found, code = _documents(doc, dl, count), (place % FIELD * 4 + place // FIELD).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("term"), pa.array(_salts(doc), pa.int32()), _binary(found, np.arange(len(doc))), _binary(code, np.cumsum(count) - count)], names=["term", "salt", "docs", "places"])

    return rows.select("term", "doc_id", "dl", "places").mapInArrow(run, _INVERTED_DDL)


def _cut(rows: pa.Table, block: int) -> pa.RecordBatch:
    """Blocks of rows that are sorted by term."""
    names = rows["term"].combine_chunks()
    (found, size), (code, _) = _values(rows["docs"], _DOCUMENT), _values(rows["places"], np.dtype("<i4"))
    doc, dl, count = found["doc"], found["dl"], found["count"].astype(np.int64)
    place = (code & 3).astype(np.int64) * FIELD + (code >> 2)
    new = pc.not_equal(names.slice(1), names.slice(0, len(names) - 1)).to_numpy(zero_copy_only=False)
    term = np.repeat(np.append(0, np.cumsum(new)), size)
    first = np.cumsum(count) - count
    f = np.add.reduceat(np.array([*WEIGHTS.values()])[place // FIELD], first)
    size = np.bincount(term)
    mean = np.maximum(1.0, np.bincount(term, dl) / size)
    impact = f / (f + K1 * (1 - B + B * dl / mean[term]))
    order = np.lexsort((-impact, term))
    of = np.empty(len(doc), np.int64)  # a document's block among its term's
    of[order] = (np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)) // block
    order = np.lexsort((doc, of, term))
    term, of, count = term[order], of[order], count[order]
    heads = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (of[1:] != of[:-1])))
    edges = pa.array(np.append(heads, len(doc)), pa.int32())
    ends = np.cumsum(count)
    moved_places = place[np.repeat(first[order] - (ends - count), count) + np.arange(len(place))]
    lists = lambda values: pa.ListArray.from_arrays(edges, values)
    places = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(moved_places))
    words = names.take(pa.array(np.flatnonzero(np.append(True, new))[term[heads]]))
    return pa.RecordBatch.from_arrays(
        [words, pa.array(np.diff(np.append(heads, len(doc))), pa.int32()), pa.array(np.add.reduceat(count, heads)), pa.array(np.maximum.reduceat(impact[order], heads)), pa.array(mean[term[heads]]), lists(pa.array(doc[order])), lists(pa.array(dl[order], pa.int32())), lists(pa.array(f[order])), lists(places)],
        names=["term", "n", "cf", "top", "mean", "doc_ids", "dls", "fs", "places"],
    )


def _blocks(sorted_rows: DataFrame) -> DataFrame:
    """Blocks of ``inverted`` rows that are sorted by term; some PIECE places are looked at together, so a term with more has the best ones of each such part together."""
    block, piece = BLOCK, PIECE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            ends = np.cumsum(pc.binary_length(b.column("places")).to_numpy(zero_copy_only=False).astype(np.int64) // 4)
            at = 0
            while at < b.num_rows:
                before = int(ends[at - 1]) if at else 0
                to = min(b.num_rows, int(np.searchsorted(ends, before + piece - n)) + 1)
                held.append(b.slice(at, to - at))
                n, at = n + int(ends[to - 1]) - before, to
                if n >= piece:
                    yield _cut(pa.Table.from_batches(held), block)
                    held, n = [], 0
        if held:
            yield _cut(pa.Table.from_batches(held), block)

    return sorted_rows.select("term", "docs", "places").mapInArrow(run, _BLOCK_DDL)


def made(docs: DataFrame, gone: DataFrame | None, analyzer: str, number: int, paired: list[str], marks: DataFrame) -> dict[str, DataFrame]:
    """A segment's tables: ``docs`` (doc_id, collection, path, title, body) came, ``gone`` (the same columns, as they were) went, ``marks`` (doc_id) are not to be found in earlier segments. One shuffle and one sort, of a row for each term and some thousands of documents."""
    blocks = _blocks(inverted(docs, analyzer, paired).repartition("term", "salt").sortWithinPartitions("term"))
    size = lambda d: d.select("doc_id", sum((F.size(terms(x)) for x in _texts().values()), F.lit(0)).alias("dl"))  # noqa: E731  whatever the analyzer, a word is a term
    counted, lengths = blocks.limit(0).select("term", F.lit(0).cast("long").alias("df"), "cf", "top", "mean"), size(docs).withColumn("sign", F.lit(1))
    if gone is not None:
        less = inverted(gone, analyzer, paired).groupBy("term").agg((-F.sum(F.octet_length("docs")) / _DOCUMENT.itemsize).cast("long").alias("df"), (-F.sum(F.octet_length("places")) / 4).cast("long").alias("cf"))
        counted = less.select("term", "df", "cf", F.lit(0.0).alias("top"), F.lit(float("inf")).alias("mean"))
        lengths = lengths.unionByName(size(gone).withColumn("sign", F.lit(-1)))
    totals = lengths.agg(F.coalesce(F.sum("sign"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("sign") * F.col("dl")), F.lit(0)).alias("tokens"))
    number_ = F.lit(number).alias("segment")
    return {"postings": blocks.select("*", number_), "less": counted, "totals": totals.select("n", "tokens", F.array(*map(F.lit, paired)).cast("array<string>").alias("paired"), number_), "marks": marks.select("doc_id", number_)}


def dictionary(postings: DataFrame, less: DataFrame, number: int) -> DataFrame:
    """A segment's dictionary, from its written blocks and what went."""
    came = postings.select("term", F.col("n").cast("long").alias("df"), "cf", "top", "mean")
    both = came.unionByName(less)
    return both.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"), F.max("top").alias("top"), F.min("mean").alias("mean")).where("df <> 0 OR cf <> 0 OR top > 0").select("*", F.lit(number).alias("segment"))


def merged(tables: dict[str, DataFrame], numbers: list[int], oldest: bool) -> dict[str, DataFrame]:
    """One segment in place of several in a row (``oldest``: the index' first is among them, so nothing older can be marked)."""
    number, own = numbers[-1], F.col("segment").isin(numbers)
    some = {k: t.where(own) for k, t in tables.items()}
    rows = live(_exploded(some["postings"], ["places"]), some["marks"])
    blocks = _blocks(_repacked(rows).repartitionByRange("term", "salt").sortWithinPartitions("term"))
    words = some["dictionary"].groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"), F.max("top").alias("top"), F.min("mean").alias("mean"))
    totals = some["totals"].agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"), F.first("paired").alias("paired"))
    number_, marks = F.lit(number).alias("segment"), some["marks"].select("doc_id").distinct()
    return {"postings": blocks.select("*", number_), "dictionary": (words.where("df > 0") if oldest else words).select("*", number_), "totals": totals.select("*", number_), "marks": (marks.where(F.lit(False)) if oldest else marks).select("doc_id", number_)}


def to_merge(sizes: list[tuple[int, int]]) -> list[int] | None:
    """Of (number, size) in order, the longest run at the end of FAN segments or more in which none is more than TIER times as large as all after it together; None if there is none."""
    run, total = [], 0
    for number, size in reversed(sizes):
        if run and size > TIER * total:
            break
        run.insert(0, number)
        total += max(1, size)
    return run if len(run) >= FAN else None


def _exploded(blocks: DataFrame, more: list[str] = ()) -> DataFrame:
    """term, segment, doc_id, dl, f (and places) of blocks."""
    cols = {"doc_ids": "doc_id", "dls": "dl", "fs": "f", "places": "places"}
    wanted = ["doc_ids", "dls", "fs", *more]
    return blocks.select("term", "segment", F.explode(F.arrays_zip(*(F.col(c) for c in wanted))).alias("x")).select("term", "segment", *(F.col(f"x.{c}").alias(cols[c]) for c in wanted))


def live(rows: DataFrame, marks: DataFrame | None) -> DataFrame:
    """Rows whose document no later segment marks."""
    if marks is None:
        return rows
    gone = marks.groupBy("doc_id").agg(F.max("segment").alias("until"))
    return rows.join(gone, (rows["doc_id"] == gone["doc_id"]) & (rows["segment"] < gone["until"]), "left_anti")


@dataclass
class Segmented:
    """A reader of segments' tables (all segments of each in one frame)."""

    postings: DataFrame
    words: DataFrame
    totals: DataFrame
    marks: DataFrame | None = None  # None: one segment, which nothing marks

    def known(self, phrases: list[Phrase]) -> tuple[int, float, list[str], dict[str, tuple[int, float, float]]]:
        """Documents, mean length, paired words; (df, top, mean) of the phrases' exact words: a few rows, in one read."""
        words = sorted({w for p in phrases for w in p.tokens})
        total = self.totals.agg(F.sum("n").alias("df"), F.sum("tokens").cast("double").alias("top"), F.lit(0.0).alias("mean"), F.first("paired").alias("paired")).select(F.lit(None).cast("string").alias("term"), "*")
        found = self.words.where(F.col("term").isin(words)).groupBy("term").agg(F.sum("df").alias("df"), F.max("top").alias("top"), F.min("mean").alias("mean"), F.lit(None).cast("array<string>").alias("paired"))
        rows = total.unionByName(found).collect()
        t = next(r for r in rows if r["term"] is None)
        return t["df"] or 0, (t["top"] / t["df"] if t["df"] else 1.0) or 1.0, list(t["paired"] or []), {r["term"]: (r["df"], r["top"], r["mean"]) for r in rows if r["term"] is not None and r["df"] > 0}

    def dictionary(self) -> DataFrame:
        """term, df, cf of single words."""
        counts = self.words.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
        return counts.where((F.col("df") > 0) & ~F.col("term").contains(" "))

    def statistics(self, phrases: list[Phrase]) -> Statistics:
        n, avgdl, _, words = self.known(phrases)
        if all(len(p.tokens) == 1 and not p.prefix for p in phrases):
            return Statistics(n, avgdl, [words.get(p.tokens[0], (0,))[0] for p in phrases])
        counts = [F.count_if(F.col("f")[k] > 0) for k in range(len(phrases))]
        return Statistics(n, avgdl, list(self.frequencies(phrases, 0).agg(*counts).first()))

    def slots(self, p: Phrase, paired: set[str]) -> list[tuple[int, str, bool]]:
        """(offset, term, prefix?) whose places make up a phrase: pairs of paired words where there are any."""
        out, k = [], 0
        while k < len(p.tokens):
            a, b = p.tokens[k], p.tokens[k + 1] if k + 1 < len(p.tokens) else None
            if b is not None and a in paired and b in paired and not (p.prefix and k + 2 == len(p.tokens)):
                out.append((k, f"{a} {b}", False))
                k += 1 if k + 2 < len(p.tokens) and p.tokens[k + 2] in paired and not (p.prefix and k + 3 == len(p.tokens)) else 2
            else:
                out.append((k, a, p.prefix and k == len(p.tokens) - 1))
                k += 1
        return out

    def frequencies(self, phrases: list[Phrase], needed: int, paired: list[str] | None = None, least: dict[str, Column] | None = None) -> DataFrame:
        """doc_id, dl, f (weighted places of each phrase) of documents with a term of them; ``least``: which blocks of a term to read."""
        pairs = set(self.totals.select("paired").first()[0] or []) if paired is None else set(paired)
        made = [self.slots(p, pairs) for p in phrases]
        term, test = F.col("term"), {}
        for s in {x[1:] for slots in made for x in slots}:
            # a pair is no word that begins with a prefix
            test[s] = (term.startswith(s[0]) & ~term.contains(" ")) if s[1] else (term == s[0])
        wanted = {s: c & least[s[0]] if least and s[0] in least else c for s, c in test.items()}
        placed = any(len(slots) > 1 for slots in made)
        blocks = self.postings.where(_any(wanted.values()) if wanted else F.lit(False))
        rows = live(_exploded(blocks, ["places"] if placed else []), self.marks)
        aggs, at = [F.first("dl").alias("dl")], {}
        for s, fits in test.items():
            at[s] = f"s{len(at)}"
            aggs.append(F.sum(F.when(fits, F.col("f")).otherwise(0.0)).alias(f"f{at[s]}"))
            if placed:
                aggs.append(F.flatten(F.collect_list(F.when(fits, F.col("places")))).alias(f"p{at[s]}"))
        per_doc = rows.groupBy("doc_id").agg(*aggs)
        weight = lambda x: reduce(lambda rest, kw: F.when(x < (kw[0] + 1) * FIELD, kw[1]).otherwise(rest), reversed(list(enumerate(WEIGHTS.values()))), F.lit(0.0))

        def weighted(slots: list) -> Column:
            if len(slots) == 1:
                return F.col(f"f{at[slots[0][1:]]}")
            starts = [moved(F.col(f"p{at[s[1:]]}"), s[0]) for s in slots]
            return F.aggregate(reduce(F.array_intersect, starts), F.lit(0.0), lambda a, x: a + weight(x))

        return per_doc.select("doc_id", "dl", F.array(*map(weighted, made)).alias("f"))

    def best(self, plan: LexPlan, limit: int | None) -> DataFrame:
        """doc_id, bm25, score of the best ``limit`` documents (None: of all that fit), by the score's twelfth decimal, then doc_id."""
        n, avgdl, paired, words = self.known(plan.positive)
        phrases, size = [*plan.positive, *(p for g in plan.negative for p in g)], len(plan.positive)
        exact = all(len(p.tokens) == 1 and not p.prefix for p in plan.positive)
        idf = lambda df: F.greatest(F.log((F.lit(float(n)) - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))
        part = lambda w, f, dl: w * f * (K1 + 1) / (f + K1 * (1 - B + B * dl / avgdl))
        least = None
        if exact:
            weights = [idf(F.lit(float(words.get(p.tokens[0], (0,))[0]))) for p in plan.positive]
            if limit and min((words.get(p.tokens[0], (0,))[0] for p in plan.positive), default=0) > WORTH * BLOCK and not plan.negative:
                least = self._thresholds(plan, weights, words, avgdl, paired, limit)
        rows = self.frequencies(phrases, size, paired, least)
        f = F.col("f")
        if not exact:
            df = rows.agg(*(F.count_if((f[k] > 0) & F.col("dl").isNotNull()).alias(f"df{k}") for k in range(size)))
            rows = rows.crossJoin(F.broadcast(df))  # one row
            weights = [idf(F.col(f"df{k}").cast("double")) for k in range(size)]
        wanted, at = [f[k] > 0 for k in range(size)], size
        for group in plan.negative:
            wanted.append(~_all(f[at + k] > 0 for k in range(len(group))))
            at += len(group)
        raw = reduce(lambda a, b: a + b, (part(w, f[k], F.col("dl")) for k, w in enumerate(weights)))
        found = rows.where(_all(wanted)).select("doc_id", raw.alias("bm25")).select("doc_id", "bm25", (F.col("bm25") / (1 + F.col("bm25"))).alias("score"))
        return found.orderBy(F.desc(F.round("score", 12)), "doc_id").limit(limit) if limit else found

    def _thresholds(self, plan: LexPlan, weights: list[Column], words: dict, avgdl: float, paired: list[str], limit: int) -> dict[str, Column] | None:
        """What a block's bound must reach, by word: from the kth score among the documents that are in the best blocks of all words."""
        own = {p.tokens[0]: w for p, w in zip(plan.positive, weights)}
        # top is f / (f + d) with d for a mean length of then; by now d is no less than min(1, then / now) of that
        bound = lambda w, top, mean: w * (K1 + 1) / (1 + F.least(F.lit(1.0), mean / avgdl) * (1 / top - 1))
        heads = [self.postings.where(F.col("term") == w).select("term", bound(own[w], F.col("top"), F.col("mean")).alias("b")).orderBy(F.desc("b")).limit(FIRST_BLOCKS) for w in own]
        edges: dict[str, float] = {}
        for r in reduce(DataFrame.unionByName, heads).collect():  # FIRST_BLOCKS a word
            edges[r["term"]] = min(edges.get(r["term"], r["b"]), r["b"])
        # real scores of some documents: the kth best of all is no lower than theirs
        some = self.frequencies(plan.positive, len(plan.positive), paired, {w: bound(own[w], F.col("top"), F.col("mean")) >= e for w, e in edges.items()})
        f = F.col("f")
        raw = sum((w * f[k] * (K1 + 1) / (f[k] + K1 * (1 - B + B * F.col("dl") / avgdl)) for k, w in enumerate(weights)), F.lit(0.0))
        first = some.where(_all(f[k] > 0 for k in range(len(weights)))).select(raw.alias("s")).orderBy(F.desc("s")).limit(limit).collect()
        if len(first) < limit:
            return None
        kth = first[-1]["s"] * (1 - 1e-9) - 1e-12
        most = {w: bound(own[w], F.lit(words[w][1]), F.lit(words[w][2])) for w in own}
        out = {}
        for w in own:
            rest = sum((most[x] for x in own if x != w), F.lit(0.0))
            out[w] = bound(own[w], F.col("top"), F.col("mean")) >= F.lit(kth) - rest
        return out



def single(docs: DataFrame, analyzer: str = "simple") -> dict[str, DataFrame]:
    """The tables of an index of one segment, but for the dictionary, which ``dictionary`` makes of the written postings."""
    return made(docs, None, analyzer, 1, paired_words(docs, analyzer), docs.select("doc_id").limit(0))
