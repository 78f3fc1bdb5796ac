"""BM25 over three fields, phrases and prefixes included.

A query's phrases give each document a row (doc_id, dl, f): its length and the
phrases' weighted occurrences in the fields. The rows come either from an
inverted index (``Postings``: one selective read of a table sorted by term, and
one shuffle of what it gives, by document) or from a pass over the texts
(``Scan``: no shuffle, for frames that were never indexed). Okapi BM25 (Robertson
and Zaragoza, 2009) is an expression over such a row, with document frequencies of
whole phrases over the whole index, which are read first: one row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.analyzer import certain, stems, terms
from tarn.functions.text import token_count, tokens
from tarn.plans.lexquery import LexPlan, Phrase

#: Weights of the fields, and BM25's parameters (fixed values).
WEIGHTS = {"filepath": 1.5, "title": 4.0, "body": 1.0}
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: A place is its field's number times this plus its number in the field.
FIELD = 1 << 40


def _texts() -> dict[str, Column]:
    return {"filepath": F.concat_ws("/", "collection", "path"), "title": F.col("title"), "body": F.col("body")}


def _any(tests) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _all(tests) -> Column:
    return reduce(lambda a, b: a & b, tests)


@dataclass
class Statistics:
    """Documents, their mean length, and in how many of them each phrase is."""

    n: int
    avgdl: float
    frequency: list[int]


def _counted(rows: DataFrame, n_phrases: int) -> list[int]:
    """In how many rows each phrase is: one small row."""
    counts = [F.count_if(F.col("f")[k] > 0).alias(f"f{k}") for k in range(n_phrases)]
    return list(rows.agg(*counts).first()) if counts else []


@dataclass
class Scan:
    """Documents that were never indexed: doc_id, collection, path, title, body. Only those whose lower-cased text holds a wanted word somewhere are cut into terms; of the others tokens are counted."""

    docs: DataFrame
    analyzer: str = "simple"

    def lengths(self) -> DataFrame:
        n = sum((token_count(F.coalesce(x, F.lit(""))) for x in _texts().values()), F.lit(0))
        return self.docs.select("doc_id", n.alias("dl"))

    def _holds(self, p: Phrase) -> Column:
        if self.analyzer != "simple":
            held = lambda w: _any(F.coalesce(x, F.lit("")).rlike(r"[^\x00-\x7F]") | F.lower(F.coalesce(x, F.lit(""))).contains(certain(w)) for x in _texts().values())
            return _all(map(held, p.tokens))
        held = lambda w: _any(F.lower(F.coalesce(x, F.lit(""))).contains(w) for x in _texts().values())
        return _all(map(held, p.tokens))

    def _terms(self, x: Column, phrases: list[Phrase]) -> Column:
        """A field's terms. With stems and phrases of one word, only those of words that can have a wanted stem: they begin as it does, or have other characters than ASCII's."""
        if self.analyzer == "simple" or any(len(p.tokens) > 1 for p in phrases):
            return terms(x, self.analyzer)
        starts = [certain(p.tokens[0]) for p in phrases]
        can = lambda w: _any([w.rlike(r"[^\x00-\x7F]"), *(w.startswith(s) for s in starts)])
        return stems(F.filter(tokens(F.coalesce(x, F.lit(""))), can), self.analyzer)

    def statistics(self, phrases: list[Phrase]) -> Statistics:
        """One pass over all texts."""
        some = self.docs.withColumn("holds", _any(map(self._holds, phrases)))
        cut = some.select("holds", *(F.when(F.col("holds"), self._terms(x if self.analyzer == "simple" else F.when(F.col("holds"), x), phrases)).alias(f) for f, x in _texts().items()), sum((F.when(~F.col("holds") | F.lit(self.analyzer != "simple"), token_count(F.coalesce(x, F.lit("")))) for x in _texts().values()), F.lit(0)).alias("rest"))
        dl = F.when(F.col("holds") & F.lit(self.analyzer == "simple"), sum((F.size(f) for f in WEIGHTS), F.lit(0))).otherwise(F.col("rest"))
        held = [F.count_if(F.col("holds") & (_weighted(p) > 0)) for p in phrases]
        n, avgdl, *frequency = cut.agg(F.count(F.lit(1)), F.avg(dl), *held).first()
        return Statistics(n, avgdl or 1.0, frequency)

    def frequencies(self, phrases: list[Phrase], needed: int | list[list[Phrase]]) -> DataFrame:
        """doc_id, dl, f of documents that can hold the first ``needed`` phrases, or all of one of several lists of phrases."""
        lists = [phrases[:needed]] if isinstance(needed, int) else needed
        some = self.docs.where(_any(_all(self._holds(p) for p in x) for x in lists))
        size = sum((token_count(F.coalesce(x, F.lit(""))) for x in _texts().values()), F.lit(0)) if self.analyzer != "simple" else F.lit(0)
        cut = some.select("doc_id", size.alias("size"), *(self._terms(x, phrases).alias(f) for f, x in _texts().items()))
        return cut.select("doc_id", (F.col("size") if self.analyzer != "simple" else sum((F.size(f) for f in WEIGHTS), F.lit(0))).alias("dl"), F.array(*map(_weighted, phrases)).alias("f"))


def _fits(x: Column, p: Phrase, slot: int) -> Column:
    word = p.tokens[slot]
    return x.startswith(word) if p.prefix and slot == len(p.tokens) - 1 else x == word


def _weighted(p: Phrase) -> Column:
    return sum((F.lit(w) * occurrences(F.col(f), p) for f, w in WEIGHTS.items()), F.lit(0.0))


def occurrences(array: Column, p: Phrase) -> Column:
    """Places of a phrase in an array of terms."""
    if len(p.tokens) == 1:
        return F.size(F.filter(array, lambda x: _fits(x, p, 0)))

    def here(x, i):
        later = (_fits(F.get(array, i + k), p, k) for k in range(1, len(p.tokens)))
        return reduce(lambda a, b: a & F.coalesce(b, F.lit(False)), later, _fits(x, p, 0))

    return F.size(F.filter(array, here))


def moved(places: Column, back: int) -> Column:
    """Where a phrase would have to start for its word number ``back`` to be at these places."""
    return F.transform(places, lambda x: x - back)


@dataclass
class Postings:
    """An inverted index: postings (term, doc_id, dl, places) and lengths (doc_id, dl), from which only two sums are read."""

    postings: DataFrame
    doc_lengths: DataFrame
    #: doc_id, term of every place, dealt by doc_id, where the postings aren't stored: what counts need is not gathered into lists.
    places: DataFrame | None = None

    @classmethod
    def build(cls, docs: DataFrame, analyzer: str = "simple") -> Postings:
        """Both tables from documents. The texts are shuffled by doc_id; their terms, several times as much, are then gathered where they are."""
        docs = docs.select("doc_id", "collection", "path", "title", "body").repartition("doc_id")
        arrays = docs.select("doc_id", *(terms(x, analyzer).alias(f) for f, x in _texts().items()))
        dl = sum((F.size(f) for f in WEIGHTS), F.lit(0))
        placed = lambda k, f: F.transform(F.col(f), lambda x, i: F.struct(x.alias("term"), (F.lit(k * FIELD) + i).alias("place")))
        long = arrays.select("doc_id", dl.alias("dl"), F.explode(F.concat(*(placed(k, f) for k, f in enumerate(WEIGHTS)))).alias("x"))
        postings = long.groupBy(F.col("x.term").alias("term"), "doc_id").agg(F.first("dl").alias("dl"), F.sort_array(F.collect_list("x.place")).alias("places"))
        each = arrays.select("doc_id", F.explode(F.concat(*WEIGHTS)).alias("term"))
        return cls(postings, Scan(docs).lengths() if analyzer == "simple" else arrays.select("doc_id", dl.alias("dl")), each)

    def lengths(self) -> DataFrame:
        return self.doc_lengths

    def statistics(self, phrases: list[Phrase]) -> Statistics:
        n, avgdl = self.doc_lengths.agg(F.count(F.lit(1)), F.avg("dl")).first()
        return Statistics(n, avgdl or 1.0, _counted(self.frequencies(phrases, 0), len(phrases)))

    def frequencies(self, phrases: list[Phrase], needed: int) -> DataFrame:
        """doc_id, dl, f of documents with a term of the phrases."""
        slots = {(k, i): _fits(F.col("term"), p, i) for k, p in enumerate(phrases) for i in range(len(p.tokens))}
        rows = self.postings.where(_any(slots.values()))
        places = {s: F.flatten(F.collect_list(F.when(fits, F.col("places")))).alias(f"p{s[0]}_{s[1]}") for s, fits in slots.items()}
        weight = lambda x: reduce(lambda rest, kw: F.when(x < (kw[0] + 1) * FIELD, kw[1]).otherwise(rest), reversed(list(enumerate(WEIGHTS.values()))), F.lit(0.0))

        def weighted(k: int, p: Phrase) -> Column:
            if len(p.tokens) == 1:
                return F.aggregate(F.col(f"p{k}_0"), F.lit(0.0), lambda a, x: a + weight(x))
            starts = [moved(F.col(f"p{k}_{i}"), i) for i in range(len(p.tokens))]
            return F.aggregate(reduce(F.array_intersect, starts), F.lit(0.0), lambda a, x: a + weight(x))

        per_doc = rows.groupBy("doc_id").agg(F.first("dl").alias("dl"), *places.values())
        return per_doc.select("doc_id", "dl", F.array(*(weighted(k, p) for k, p in enumerate(phrases))).alias("f"))

    def dictionary(self) -> DataFrame:
        """term, df (documents), cf (places)."""
        if self.places is not None:
            each = self.places.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
            return each.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("cf"))
        return self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.size("places")).alias("cf"))


def _phrases(plan: LexPlan) -> list[Phrase]:
    return [*plan.positive, *(p for group in plan.negative for p in group)]


def _fit(plan: LexPlan, known: Statistics, f: list[Column]) -> tuple[Column, Column]:
    """Whether a document fits a plan, and its raw BM25: ``f`` has the occurrences of each of the plan's phrases, ``known`` counts the positive ones."""
    size, part = len(plan.positive), []
    for k, df in enumerate(known.frequency):
        idf = max(math.log((known.n - df + 0.5) / (df + 0.5)), LEAST_IDF) if df < known.n + 0.5 else LEAST_IDF
        part.append(F.lit(idf) * f[k] * (K1 + 1) / (f[k] + K1 * (1 - B + B * F.col("dl") / F.lit(known.avgdl))))
    wanted, at = [f[k] > 0 for k in range(size)], size
    for group in plan.negative:
        wanted.append(~_all(f[at + k] > 0 for k in range(len(group))))
        at += len(group)
    return _all(wanted), reduce(lambda a, b: a + b, part)


def matches(index: Scan | Postings, plan: LexPlan) -> DataFrame:
    """doc_id, raw BM25 and score x / (1 + x) of the documents with every positive phrase and no negative group."""
    if hasattr(index, "best"):
        return index.best(plan, None)
    phrases = _phrases(plan)
    known, rows = index.statistics(plan.positive), index.frequencies(phrases, len(plan.positive))
    fits, bm25 = _fit(plan, known, [F.col("f")[k] for k in range(len(phrases))])
    raw = F.abs(F.col("bm25"))
    return rows.where(fits).select("doc_id", bm25.alias("bm25")).select("doc_id", "bm25", (raw / (1 + raw)).alias("score"))


def search(index: Scan | Postings, docs: DataFrame, plan: LexPlan | None, limit: int = 20, collections: list[str] | None = None) -> DataFrame:
    """The best ``limit`` documents of a plan, exactly: with collections, document frequencies are still the whole index'."""
    wanted = docs.select("doc_id", "collection", "path", "title", "hash")
    if plan is None:
        return wanted.where(F.lit(False)).withColumn("score", F.lit(0.0))
    if collections:
        wanted = wanted.where(F.col("collection").isin(collections))
    elif hasattr(index, "best"):  # an index of whole segments: the best first, then what is told of them
        found = index.best(plan, limit)
        return wanted.join(F.broadcast(found), "doc_id").orderBy(F.desc(F.round("score", 12)), "doc_id").select("doc_id", "collection", "path", "title", "hash", "score")
    found = matches(index, plan).join(wanted, "doc_id")
    return found.orderBy(F.desc(F.round("score", 12)), "doc_id").limit(limit).select("doc_id", "collection", "path", "title", "hash", "score")


def search_all(index: Scan, docs: DataFrame, plans: list[LexPlan], limit: int = 20, collections: list[str] | None = None) -> DataFrame:
    """What ``search`` gives for each of some plans, by ``plan`` (its number) and in order: texts that were never indexed are read twice, however many plans there are."""
    from tarn.operators.ranking import ranked

    wanted = docs.select("doc_id", "collection", "path", "title", "hash")
    if collections:
        wanted = wanted.where(F.col("collection").isin(collections))
    phrases = list(dict.fromkeys(p for plan in plans for p in _phrases(plan)))
    known = index.statistics(phrases)
    rows, raw, found = index.frequencies(phrases, [plan.positive for plan in plans]), F.abs(F.col("bm25")), []
    for k, plan in enumerate(plans):
        own = Statistics(known.n, known.avgdl, [known.frequency[phrases.index(p)] for p in plan.positive])
        fits, bm25 = _fit(plan, own, [F.col("f")[phrases.index(p)] for p in _phrases(plan)])
        found.append(F.when(fits, F.struct(F.lit(k).alias("plan"), bm25.alias("bm25"))))
    each = rows.select("doc_id", F.explode(F.array_compact(F.array(*found))).alias("x")).select("x.plan", "doc_id", F.col("x.bm25").alias("bm25"))
    each = each.select("plan", "doc_id", (raw / (1 + raw)).alias("score"))
    best = ranked(each.join(wanted, "doc_id"), ["plan"], "_rank").where(F.col("_rank") < limit)
    return best.orderBy("plan", "_rank").select("plan", "doc_id", "collection", "path", "title", "hash", "score")


def search_each(index: Scan | Postings, docs: DataFrame, plan: LexPlan | None, limit: int, collections: list[str]) -> DataFrame:
    """Every collection's own best ``limit``, so that a large one doesn't starve a small one; the best score of a file, then the best ``limit`` of all."""
    from tarn.operators.ranking import best_of_file, top_of_each

    if plan is None:
        return search(index, docs, None)
    wanted = docs.where(F.col("collection").isin(collections)).select("doc_id", "collection", "path", "title", "hash")
    found = top_of_each(matches(index, plan).join(wanted, "doc_id"), ["collection"], limit)
    return best_of_file(found, ["collection", "path"]).orderBy(F.desc(F.round("score", 12)), "doc_id").limit(limit)
