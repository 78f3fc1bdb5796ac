"""Document log-likelihoods under a gated recurrent language model.

The corpus' word counts come from all training documents through the bucket
exchange: no block or task ever holds the whole vocabulary. The model's symbols
are the most frequent words, as many as the square root of the number of distinct
training words, a class for the last two bytes of any other word, and the end. A
word outside the frequent ones has the probability of its class
times its smoothed share of the class' training counts, in which one unseen word
is counted, so the model is a distribution over known words and an unseen one a
class. Context thus chooses among frequent words and classes, never between the
words of a class.

The recurrent part is trained on all training documents, whole, in rounds. A hash
of doc_id deals them to shards of about ``SHARD_TOKENS`` tokens, and each shard's
to the rounds. In a round every shard goes on from the common weights over its
documents of the round; the weights are then averaged, by tokens, to the next
common ones. Each document is learned from once, on tables of any size: a small
table has one shard, and the same rounds. Scoring covers whole texts, the state carried across windows.

A very long text is scored whole by one task, a step of the network for each word,
as each state hangs on the one before; what it holds is a few numbers a word.
Null and empty texts have the end token alone. A null doc_id is neither held out
nor learned from. Repeated rows are counted and scored each. Empty tables give
no rows; with nothing to learn from all counts are 0. Extra columns are ignored.
"""

from __future__ import annotations

import copy
import itertools
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.blocks import answered, asked, blocks, bucket_bits, filled, pack, pieces, told_several, unpack, unpack_block
from tarn.llm.gru import GRU
from tarn.llm.shared import Scratch, arrow_schema, batch
from tarn.llm.words import Words, mix, words_of

KIND = "spaced_lower"
#: Words that context chooses among: the distinct training words to this power, and no fewer than so many. Classes of all others.
FREQUENT, LEAST_FREQUENT, TAILS = 0.5, 1000, 64
#: Training tokens of a shard, and rounds.
SHARD_TOKENS, ROUNDS = 2_000_000, 4
#: Blocks scored together: long documents then have company in other lanes for longer.
TOGETHER = 3
#: Weights are added up as whole numbers of 1 / UNIT, so that the order in which shards come doesn't matter.
UNIT = 1 << 26


def learns(doc_ids: list, modulus: int, remainder: int) -> np.ndarray:
    """Whether each document is learned from."""
    return np.array([d is not None and zlib.crc32(str(d).encode()) % modulus != remainder for d in doc_ids], bool)


def tails(w: Words) -> np.ndarray:
    """Class of each word's last two bytes."""
    b = np.frombuffer(w.blob, np.uint8).astype(np.uint32)
    b[(b >= 65) & (b <= 90)] += 32
    last = b[w.end - 1]
    second = np.where(w.end - w.start > 1, b[w.end - 2], 0)
    return (((last * np.uint32(257) + second) * np.uint32(0x9E3779B1)) >> np.uint32(26)).astype(np.uint8)


class Symbols:
    """Word hash -> symbol: frequent words in order, then TAILS classes; the end is last."""

    def __init__(self, frequent: np.ndarray):
        self.keys = np.sort(frequent)
        self.end = len(self.keys) + TAILS
        self.kind = np.uint16 if self.end < 1 << 16 else np.uint32

    def of(self, h: np.ndarray, tail: np.ndarray) -> np.ndarray:
        out = len(self.keys) + tail.astype(np.int32)
        if len(self.keys):
            k = np.searchsorted(self.keys, h)
            k[k == len(self.keys)] = 0
            out = np.where(self.keys[k] == h, k, out).astype(np.int32)
        return out


def _with_ends(per_word: np.ndarray, bounds: np.ndarray, end) -> np.ndarray:
    """A value of each word, and ``end`` after each document's last."""
    return np.insert(per_word, bounds[1:], end)


def _question(content: tuple, modulus: int, remainder: int):
    ids, texts = content
    w = words_of(texts, KIND)
    keys, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
    train = np.repeat(learns(ids, modulus, remainder), w.counts())
    return w, keys, first, inverse, np.bincount(inverse[train], minlength=len(keys))


def lm_scores(docs: DataFrame, modulus: int = 5, remainder: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    table = blocks(docs, scratch)
    bits = bucket_bits(table)

    def send(content, got):
        w, keys, first, _, n = _question(content, modulus, remainder)
        tail = tails(w)[first]
        for bucket, a, b in pieces(keys, bits):
            yield bucket, keys[a:b].tobytes() + n[a:b].astype(np.uint32).tobytes() + tail[a:b].tobytes()

    def add(bucket, of, payloads):
        sizes = [len(p) // 13 for p in payloads]
        every = np.concatenate([np.frombuffer(p, np.uint64, k) for p, k in zip(payloads, sizes)])
        n = np.concatenate([np.frombuffer(p, np.uint32, k, 8 * k) for p, k in zip(payloads, sizes)]).astype(np.int64)
        tail = np.concatenate([np.frombuffer(p, np.uint8, k, 12 * k) for p, k in zip(payloads, sizes)])
        keys, first, inverse = np.unique(every, return_index=True, return_inverse=True)
        total = np.bincount(inverse, n, len(keys)).astype(np.int64)
        at = 0
        for block, k in zip(of, sizes):
            yield block, total[inverse[at : at + k]].tobytes()
            at += k
        t, known = tail[first], total > 0
        per = lambda x: np.bincount(t[known], x[known], TAILS)
        yield -1, pack(total.sum(), known.sum(), per(total), per(total + 0.5), keys[known], total[known], t[known])

    counts = scratch.table(answered(table, asked(table, send), add, kind=1), "counts", codec="none")
    own = counts.where("block >= 0")

    tops = counts.where("block < 0").select("payload")
    ddl = "tokens long, kinds long, mass binary, smoothed binary"

    def sums(batches):
        for b in batches:
            for raw in b.column(0).to_pylist():
                tokens, kinds, mass, smoothed, *_ = unpack(raw)
                yield batch(arrow_schema(ddl), {"tokens": [int(tokens)], "kinds": [int(kinds)], "mass": [mass.astype(float).tobytes()], "smoothed": [smoothed.tobytes()]})

    def words(batches):
        for b in batches:
            for raw in b.column(0).to_pylist():
                *_, keys, n, tail = unpack(raw)
                yield batch(arrow_schema("key long, n long, tail int"), {"key": keys.astype(np.int64), "n": n, "tail": tail.astype(np.int32)})

    tokens = kinds = 0
    mass, smoothed = np.zeros(TAILS), np.zeros(TAILS)
    for r in tops.mapInArrow(sums, ddl).toLocalIterator():  # one small row a bucket
        tokens, kinds = tokens + r[0], kinds + r[1]
        mass, smoothed = mass + np.frombuffer(r[2]), smoothed + np.frombuffer(r[3])
    frequent = tops.mapInArrow(words, "key long, n long, tail int").orderBy(F.desc("n"), "key").limit(max(LEAST_FREQUENT, int(np.ceil(kinds**FREQUENT)))).collect()  # the most frequent of all buckets' words
    hash_ = F.crc32(F.col("`doc_id`").cast("string")) % modulus
    ends = docs.where(hash_ != remainder).count()
    for _, n, tail in frequent:
        mass[tail] -= n
        smoothed[tail] -= n + 0.5
    smoothed = smoothed + 0.5  # an unseen word
    symbols = Symbols(np.array([r[0] for r in frequent], np.int64).astype(np.uint64))
    weight = np.zeros(symbols.end + 1)
    for key, n, _ in frequent:
        weight[np.searchsorted(symbols.keys, np.uint64(key & (2**64 - 1)))] = n
    weight[len(symbols.keys) : symbols.end] = np.maximum(0, mass)
    weight[symbols.end] = ends
    model = GRU(weight)
    train_tokens, distinct = tokens + ends, kinds + (ends > 0)
    shards = max(1, -(-train_tokens // SHARD_TOKENS))
    lessons = scratch.table(_lessons(table, symbols, modulus, remainder, shards, ROUNDS), "lessons", partition_by="round")
    _train(model, lessons, shards, ROUNDS, scratch)
    shared = spark.sparkContext.broadcast((model, symbols, np.log(smoothed)))  # about 300 bytes a symbol

    def prepared(content, got):
        """Of a block: ids, sizes, counts, what a word's share in its class adds, symbols; the ends among them."""
        ids, texts = content
        w, keys, _, inverse, _ = _question(content, modulus, remainder)
        count = filled(np.zeros(len(keys), np.int64), keys, bits, got.get(1, {}), lambda raw, n: np.frombuffer(raw, np.int64, n))
        c = count[inverse] if len(keys) else np.zeros(0, np.int64)
        _, names, class_mass = shared.value
        tail = tails(w)
        symbol = names.of(w.hash, tail)
        inside = np.where(symbol < len(names.keys), 0.0, np.log(c + 0.5) - class_mass[tail])
        return ids, w.counts() + 1, _with_ends(c, w.bounds, ends), _with_ends(inside, w.bounds, 0.0), _with_ends(symbol, w.bounds, names.end)

    def score(blocks_):
        found = [prepared(*x) for x in blocks_]
        each = shared.value[0].log_likelihood(np.concatenate([f[4] for f in found]), np.concatenate([f[1] for f in found]))
        for (ids, sizes, c, inside, symbol), own in zip(found, np.split(each, np.cumsum([len(f[4]) for f in found])[:-1])):
            first = np.cumsum(sizes) - sizes
            base = np.log10((c + 0.5) / (train_tokens + 0.5 * (distinct + 1)))
            sum_ = lambda x: np.add.reduceat(x, first)
            yield {
                "doc_id": ids, "held_out": [d is not None and not x for d, x in zip(ids, learns(ids, modulus, remainder))],
                "n_tokens": sizes, "n_known": sum_((c > 0).astype(np.int64)), "train_tokens": [train_tokens] * len(ids),
                "base_score": sum_(base), "score": sum_(own + inside) / np.log(10),
            }

    result = told_several(table, [own], "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double", score, TOGETHER)
    result = scratch.table(result, "result")
    scratch.drop("blocks", "counts", "lessons")
    return result


LESSONS = "round int, shard long, tokens long, payload binary"


def _lessons(table: DataFrame, symbols: Symbols, modulus: int, remainder: int, shards: int, rounds: int) -> DataFrame:
    """The symbols of all training documents, whole: a row for each shard and round; a payload unpacks to (symbols of all its documents, their sizes)."""
    ddl = "lesson long, h long, symbols binary"
    schema = arrow_schema(ddl)

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                ids, texts = unpack_block(b.column("payload")[k].as_py())
                at = np.flatnonzero(learns(ids, modulus, remainder))
                w = words_of([texts[i] for i in at], KIND)
                s = _with_ends(symbols.of(w.hash, tails(w)), w.bounds, symbols.end).astype(symbols.kind)
                edge = np.cumsum(np.concatenate(([0], w.counts() + 1)))
                h = mix(np.array([ids[i] for i in at], np.int64).view(np.uint64) + np.uint64(0x6C6D))
                yield batch(schema, {"lesson": (h % np.uint64(shards * rounds)).astype(np.int64), "h": h.view(np.int64), "symbols": [s[x:y].tobytes() for x, y in itertools.pairwise(edge)]})

    def gather(batches):
        rows = ((k, raw) for b in batches for k, raw in zip(b.column("lesson").to_pylist(), b.column("symbols").to_pylist()))
        for k, found in itertools.groupby(rows, key=lambda r: r[0]):
            docs = [np.frombuffer(raw, symbols.kind) for _, raw in found]
            every = np.concatenate(docs)
            yield batch(arrow_schema(LESSONS), {"round": [k % rounds], "shard": [k // rounds], "tokens": [len(every)], "payload": [pack(every, [len(d) for d in docs])]})

    return table.mapInArrow(run, ddl).repartition(max(shards, int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "lesson").sortWithinPartitions("lesson", "h", "symbols").mapInArrow(gather, LESSONS)


def _train(model: GRU, lessons: DataFrame, shards: int, rounds: int, scratch: Scratch) -> None:
    """Train ``model`` on all lessons."""
    spark = lessons.sparkSession
    for r in range(rounds):
        common = spark.sparkContext.broadcast(model)  # about 300 bytes a symbol

        def learn(batches, r=r, common=common):
            for b in batches:
                for k in range(b.num_rows):
                    symbols, sizes = unpack(b.column("payload")[k].as_py())
                    own = copy.deepcopy(common.value)
                    own.train(np.split(symbols, np.cumsum(sizes)[:-1]), 1, r / rounds, (r + 1) / rounds)
                    share = max(1, round(16 * rounds * len(symbols) / SHARD_TOKENS))
                    yield batch(arrow_schema("share long, weights binary"), {"share": [share], "weights": [own.weights().tobytes()]})

        def add(batches):
            share, total = 0, 0
            for b in batches:
                for n, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    share, total = share + n, total + n * np.rint(np.frombuffer(raw, np.float32).astype(float) * UNIT).astype(np.int64)
            if share:
                yield batch(arrow_schema("share long, total binary"), {"share": [share], "total": [total.tobytes()]})

        # a task a shard; their sums are small rows, one for each part of the table
        learned = scratch.table(lessons.where(F.col("round") == r).select("payload").repartition(shards).mapInArrow(learn, "share long, weights binary"), f"round-{r}", codec="none")
        share, total = 0, 0
        for row in learned.mapInArrow(add, "share long, total binary").toLocalIterator():
            share, total = share + row[0], total + np.frombuffer(row[1], np.int64)
        if share:
            model.load((total / (share * UNIT)).astype(np.float32))
        scratch.drop(f"round-{r}")
        common.unpersist()
