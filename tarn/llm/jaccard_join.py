"""Exact Jaccard self-join on word shingles, by token-combination prefixes, and its components.

How often a shingle occurs is counted over all blocks of documents, by its hash's
first bits. Order a set's shingles with rare ones first. Of two sets that link, all but a
quarter of either are shared, so among enough of the first ones a shared one
must be left. Rare shingles serve as signatures alone. Frequent ones (a global
class) would gather too many sets, so they are split into subclasses by hash and
only pairs of one subclass are signatures: the prefix is extended until, whatever
quarter is missing, some rare shingle or some pair of a subclass survives in
both. The number of subclasses follows the set's size class, so the pairs stay in
proportion to the size; a set near the next size class signs for that one too.

Sets with a signature in common are candidates. Groups of up to ``SMALL`` sets
give their pairs of fitting sizes. A larger group gives the pairs with its most
central set only, the one with the greatest share of frequent shingles, which an
edited copy has less of than what it was copied from. When these have been
verified and joined to components, the groups of one centre are taken together.
What lies outside their largest component is tested against that and against
itself, chunk by chunk, a task for each two chunks: nothing is left to do where
all are in one component, and no group, however large, is one task's work. No
group is cut off.

A candidate pair is first held against a lower bound of the symmetric difference
from parity bitmaps (finer ones in the last step), then verified on the sets.
Equal sets are one from the start. Shingles are 64-bit hashes throughout;
verification sends 48 bits.

Texts without words have an empty set and link with nothing; null counts as
empty. A very long text is one set, held whole by one task. Repeated rows are
equal sets. Empty tables give no rows; extra columns are ignored. A component is named by its smallest doc_id, null ids ignored.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.blocks import answered, asked, blocks, bucket_bits, dealt, pieces, unpack_block, with_replies
from tarn.llm.components import components
from tarn.llm.shared import Scratch, arrow_schema, batch, rows_of, trim
from tarn.llm.words import mix, shingles, words_of

KIND = "spaced_lower"
#: Frequent: in at least so many of all blocks' distinct sets; the MOST most frequent are told to all, the others sign as rare ones do.
TOTAL, MOST = 48, 1 << 17
#: Bits of a shingle, after its bucket's, by which it is counted.
COUNTED = 24
#: Sets of a group that gives all its pairs of fitting sizes. A larger group's chunks: a CHUNKS-th of it, but no fewer and no more sets than this.
SMALL, CHUNKS, LEAST_CHUNK, MOST_CHUNK = 64, 8, 128, 4096
#: Pairs that a task holds at once.
PAIRS = 1 << 21
#: Parts that the documents of a component, or of equal sets, are dealt into when they get its name.
SALTS = 64
#: Base of the size code: sizes that can link differ by FITS codes at most.
STEP = 1.06
#: Bits a shingle in the bitmaps of the last step.
FINE = 8


class Join:
    """Bounds for a similarity of num/den on shingles of ``size`` words."""

    def __init__(self, size: int, num: int, den: int):
        self.size, self.num, self.den = size, num, den
        self.fits = int(np.ceil(np.log(den / num) / np.log(STEP))) + 1

    def kills(self, n: int) -> int:
        """One more than the shingles of a set of n that can be missing in a set that links with it."""
        return n + self.num * n // -self.den + 1

    def near(self, nx, ny, difference):
        """Whether sets of these sizes with this symmetric difference (or more) can link."""
        both = (nx + ny - difference) // 2
        return self.den * both >= self.num * (nx + ny - both)

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        """Each text's distinct shingles, sorted."""
        w = words_of(texts, KIND)
        h = shingles(w.hash, self.size)
        out = []
        for a, b in itertools.pairwise(w.bounds.tolist()):
            if b - a >= self.size:
                out.append(np.unique(h[a : b - self.size + 1]))
            elif b > a:
                out.append(mix(shingles(w.hash[a:b], b - a) + np.uint64(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
        return out

    def signatures(self, s: np.ndarray, often: np.ndarray) -> np.ndarray:
        """A set's signatures: rare shingles of the prefix, and pairs of frequent ones (where ``often``) of a subclass."""
        n = len(s)
        need = self.kills(n)
        rare = s[~often]
        if len(rare) >= need:
            return rare[:need]
        out, freq, need = [rare], s[often], need - len(rare)
        level = n.bit_length() - 1
        upward = -(-self.den * n // self.num) >= 2 << level  # a larger set that links can be in the next size class
        for t in (level, level + 1) if upward else (level,):
            classes = max(1, (1 << t) // 4)
            sub = ((freq >> np.uint64(13)) % np.uint64(classes)).astype(np.int64)
            seen = np.zeros(len(freq), bool)
            seen[np.unique(sub, return_index=True)[1]] = True  # a subclass' first member kills no pair
            enough = np.flatnonzero(np.cumsum(~seen) >= need)
            end = int(enough[0]) + 1 if len(enough) else len(freq)
            f, g = freq[:end], sub[:end]
            order = np.argsort(g, kind="stable")
            f, g = f[order], g[order]
            place = np.arange(end) - np.searchsorted(g, g)
            hi = np.repeat(np.arange(end), place)  # each with all before it in its subclass
            lo = hi - place[hi] + np.arange(len(hi)) - np.repeat(np.cumsum(place) - place, place)
            out.append(mix(f[lo] * np.uint64(0x9E3779B97F4A7C15) + f[hi] + np.uint64(t)))
        return np.unique(np.concatenate(out))


def among(s: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``s`` are in the sorted ``known``."""
    if not len(known):
        return np.zeros(len(s), bool)
    k = np.searchsorted(known, s)
    k[k == len(known)] = 0
    return known[k] == s


def parity(s: np.ndarray, each: int = 1) -> bytes:
    """Bitmap of about ``each`` bits a shingle: whether an odd number fell on it."""
    bits = each * (max(64, 1 << (len(s) - 1).bit_length()) if len(s) else 64)
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def difference(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference, from two bitmaps; the longer one is folded."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def size_code(n: np.ndarray) -> np.ndarray:
    return np.minimum(255, np.log(np.maximum(1, n)) / np.log(STEP)).astype(np.uint8)


def _narrow(s: np.ndarray) -> bytes:
    """The set in 48 bits a shingle."""
    return np.unique(s & np.uint64((1 << 48) - 1)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _wide(raw: bytes) -> np.ndarray:
    x = np.zeros((len(raw) // 6, 8), np.uint8)
    x[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return x.view(np.uint64)[:, 0]


def jaccard_components(docs: DataFrame, size: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row. The links that components rest on are verified; not all links inside a component are, so their number isn't told."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    join = Join(size, num, den)
    table = blocks(docs, scratch)
    bits = bucket_bits(table)

    def describe(batches):
        schema = arrow_schema(SETS)
        for block, (ids, texts) in _each(batches):
            found = join.sets(texts)
            yield batch(schema, {
                "gid": [block << 16 | k for k in range(len(ids))], "doc_id": ids, "n": [len(s) for s in found],
                "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in found],
                "sketch": [parity(s) for s in found], "fine": [parity(s, FINE) for s in found],
            })

    rows = scratch.table(table.mapInArrow(describe, SETS), "sets")
    member = _with_least(rows.select("gid", "doc_id", "digest", "n"), ["digest", "n"], "gid", "rep")
    member = scratch.table(member.select("gid", "doc_id", "n", F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("gid")).alias("rep")), "members")
    sketches = scratch.table(rows.drop("fine").join(member.where("n > 0").select("gid", "rep"), "gid").select("gid", "rep", "n", "sketch"), "sketches")

    def distinct(content):
        """(number in block, set) of each distinct set of a block that can have a partner."""
        seen = set()
        for k, s in enumerate(join.sets(content[1])):
            if len(s) > 1 and (key := s.tobytes()) not in seen:
                seen.add(key)
                yield k, s

    shift = np.uint64(64 - bits - COUNTED)

    def occurring(content, got):
        """To each bucket: the first bits of the block's distinct sets' shingles, and how many more sets have those that several have."""
        own = [s for _, s in distinct(content)]
        keys, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *own]), return_counts=True)
        low = ((keys >> shift) & np.uint64((1 << COUNTED) - 1)).astype("<u4")
        for bucket, a, b in pieces(keys, bits):
            x, more = low[a:b], np.flatnonzero(n[a:b] > 1)
            yield bucket, np.int64(b - a).tobytes() + x.view(np.uint8).reshape(-1, 4)[:, :3].tobytes() + x[more].tobytes() + (n[a:b][more] - 1).astype("<u4").tobytes()

    def added(bucket, of, payloads):
        low, n = [], []
        for p in payloads:
            k = int(np.frombuffer(p, np.int64, 1)[0])
            x = np.zeros((k, 4), np.uint8)
            x[:, :3] = np.frombuffer(p, np.uint8, 3 * k, 8).reshape(-1, 3)
            rest = np.frombuffer(p[8 + 3 * k :], "<u4").reshape(2, -1)
            low += [x.view("<u4")[:, 0], rest[0]]
            n += [np.ones(k, np.uint32), rest[1]]
        low, n = np.concatenate(low), np.concatenate(n)
        order = np.argsort(low, kind="stable")
        low, n = low[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
        total = np.add.reduceat(n.astype(np.int64), first)
        often = total >= TOTAL
        yield -1, np.stack((low[first][often].astype(np.int64) | (bucket << COUNTED), total[often])).tobytes()

    # written first: two Python steps in one stage are two workers a core
    counts = scratch.table(answered(table, asked(table, occurring), added), "counts")
    top = counts.select("payload").mapInArrow(_flat("shingle long, n long"), "shingle long, n long").orderBy(F.desc("n"), "shingle").limit(MOST).select("shingle").collect()
    frequent = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in top], np.int64).astype(np.uint64)))  # at most MOST

    def sign(content, got):
        sig, at, code, share = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
        for k, s in distinct(content):
            often = among(s >> shift, frequent.value)
            g = join.signatures(s, often)
            sig.append(g)
            at.append(np.full(len(g), k))
            code.append(np.full(len(g), len(s)))
            share.append(np.full(len(g), int(255 * often.mean()), np.uint8))
        sig, at, code, share = (np.concatenate(x) for x in (sig, at, code, share))
        sig = mix(sig)  # the prefix has the smallest shingles: spread them over the buckets
        order = np.argsort(sig, kind="stable")
        sig, at, code, share = sig[order], at[order].astype(np.uint16), size_code(code[order]), share[order]
        low = (sig >> np.uint64(32 - bits)).astype(np.uint32)
        for bucket, a, b in pieces(sig, bits):
            yield bucket, low[a:b].tobytes() + at[a:b].tobytes() + code[a:b].tobytes() + share[a:b].tobytes()

    def gather(bucket, of, payloads):
        sizes = [len(p) // 8 for p in payloads]
        low = np.concatenate([np.frombuffer(p, np.uint32, k) for p, k in zip(payloads, sizes)])
        gid = np.concatenate([np.frombuffer(p, np.uint16, k, 4 * k).astype(np.int64) | (block << 16) for p, k, block in zip(payloads, sizes, of)])
        code = np.concatenate([np.frombuffer(p, np.uint8, k, 6 * k) for p, k in zip(payloads, sizes)]).astype(np.int16)
        share = np.concatenate([np.frombuffer(p, np.uint8, k, 7 * k) for p, k in zip(payloads, sizes)]).astype(np.int16)
        order = np.lexsort((gid, -share, low))  # a group's most central set is its first
        low, gid, code = low[order], gid[order], code[order]
        edge = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1], [True])))
        names, own = np.unique(gid, return_inverse=True)
        first, n = edge[:-1], np.diff(edge)
        for keys in _pairs(first, n, own, code, join.fits, len(names)):
            yield 0, np.stack((names[keys // len(names)], names[keys % len(names)])).tobytes()
        for keys in _members(first, n, own, len(names)):
            yield 1, np.stack((names[keys // len(names)], names[keys % len(names)])).tobytes()

    groups = scratch.table(answered(table, asked(table, sign), gather), "groups")
    pairs = groups.where("block = 0").select("payload").mapInArrow(_flat("a long, b long"), "a long, b long").distinct()
    verified = _verify(pairs, sketches, table, join, scratch, "first")
    large = scratch.table(groups.where("block = 1").select("payload").mapInArrow(_flat("centre long, gid long"), "centre long, gid long").distinct(), "large")
    scratch.drop("groups", "counts")
    labels = components(verified, scratch, "first")
    named = member.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("gid", "doc_id", "n", F.coalesce("label", "rep").alias("label"))
    rest = _cross(large, labels, sketches, rows, join, scratch)
    if rest is not None:
        more = _verify(rest, sketches, table, join, scratch, "second", screened=True)
        edges = scratch.table(_of_labels(more, labels), "label-edges")
        further = components(edges, scratch, "second").select(F.col("node").alias("label"), F.col("label").alias("further"))
        named = named.join(further, "label", "left").withColumn("label", F.coalesce("further", "label")).drop("further")
    result = _with_least(named, ["label"], "doc_id", "component_id").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    result = scratch.table(result, "result")
    scratch.drop("blocks", "sets", "members", "sketches", "large")
    return result


def _of_labels(links: DataFrame, labels: DataFrame) -> DataFrame:
    """The links as distinct edges between the components that their ends are in so far."""
    for end in ("a", "b"):
        links = links.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"of_{end}")), end, "left").withColumn(f"of_{end}", F.coalesce(f"of_{end}", end))
    return links.where("of_a != of_b").select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b")).distinct()


def _with_least(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """``rows`` (with a gid) and the least ``value`` among those of the same ``keys``. A key's rows are dealt into SALTS parts, so that a group of any size is no single task's."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("gid"), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy(*keys, "salt").agg(F.min(value).alias("least"))
    names = parts.join(parts.groupBy(*keys).agg(F.min("least").alias(name)), keys).select(*keys, "salt", name)
    return salted.join(names, [*keys, "salt"]).drop("salt")


SETS = "gid long, doc_id long, n long, digest binary, sketch binary, fine binary"


def _each(batches):
    """(block, content) of every block."""
    for b in batches:
        for k in range(b.num_rows):
            r = b.slice(k, 1).to_pylist()[0]
            yield r["block"], unpack_block(r["payload"])
    trim()


def _sliced(batches):
    """The batches in parts of which Python holds one at a time."""
    for b in batches:
        for at in range(0, b.num_rows, 512):
            yield b.slice(at, 512)
    trim()


def _flat(ddl: str):
    """Rows of the int64 columns that a payload holds one after another."""
    schema = arrow_schema(ddl)

    def run(batches):
        for b in batches:
            for raw in b.column(0).to_pylist():
                columns = np.frombuffer(raw, np.int64).reshape(len(schema), -1)
                for at in range(0, columns.shape[1], 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)]) for c in columns], schema=schema)
        trim()

    return run


def _pairs(first: np.ndarray, n: np.ndarray, own: np.ndarray, code: np.ndarray, fits: int, total: int):
    """Candidate pairs of sets whose sizes fit, as keys smaller * total + larger: all pairs of a small group, a large group's with its first set. Distinct among the keys given at once."""
    pairs = np.where(n <= SMALL, n * (n - 1) // 2, n - 1)
    held = np.zeros(0, np.int64)
    for groups in _slices(pairs):
        small, large = groups[n[groups] <= SMALL], groups[n[groups] > SMALL]
        at, rank = _places(first[small], n[small])
        hi = np.repeat(at, rank)  # each with all before it in its group
        lo = np.repeat(at - rank, rank) + np.arange(len(hi)) - np.repeat(np.cumsum(rank) - rank, rank)
        at, rank = _places(first[large], n[large])
        hi, lo = np.concatenate((hi, at[rank > 0])), np.concatenate((lo, (at - rank)[rank > 0]))
        ok = np.abs(code[hi] - code[lo]) <= fits
        x, y = own[hi[ok]], own[lo[ok]]
        keys = np.minimum(x, y) * total + np.maximum(x, y)
        held = np.unique(np.concatenate((held, keys[x != y])))
        if len(held) >= PAIRS:
            yield held
            held = held[:0]
    yield held


def _members(first: np.ndarray, n: np.ndarray, own: np.ndarray, total: int):
    """(first set, member) of the large groups, as keys first * total + member."""
    large = np.flatnonzero(n > SMALL)
    held = np.zeros(0, np.int64)
    for groups in _slices(n[large]):
        at, rank = _places(first[large[groups]], n[large[groups]])
        held = np.unique(np.concatenate((held, own[at - rank] * total + own[at])))
        if len(held) >= PAIRS:
            yield held
            held = held[:0]
    yield held


def _slices(weight: np.ndarray) -> list[np.ndarray]:
    """Numbers of the groups, in runs of about PAIRS in weight; groups of no weight are left out."""
    some = np.flatnonzero(weight)
    of = np.cumsum(weight[some]) // PAIRS
    return np.split(some, np.flatnonzero(np.diff(of)) + 1) if len(some) else []


def _places(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all members of groups, and each one's rank in its group."""
    rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(first, n) + rank, rank


def _verify(pairs: DataFrame, sketches: DataFrame, table: DataFrame, join: Join, scratch: Scratch, name: str, screened: bool = False) -> DataFrame:
    """The pairs (a, b) of representatives of equal sets that link, each once."""
    if not screened:
        left = sketches.select(*(F.col(c).alias(f"{c}_a") for c in ("gid", "rep", "n", "sketch")))
        right = sketches.select(*(F.col(c).alias(f"{c}_b") for c in ("gid", "rep", "n", "sketch")))
        wide = pairs.join(left, F.col("a") == F.col("gid_a")).join(right, F.col("b") == F.col("gid_b"))
        wide = wide.where("rep_a != rep_b").select("rep_a", "rep_b", "n_a", "n_b", "sketch_a", "sketch_b")

        def screen(batches):
            schema = arrow_schema("a long, b long")
            for b in _sliced(batches):
                x = b.to_pydict()
                ok = [(min(p, q), max(p, q)) for p, q, m, n, s, t in zip(*x.values()) if join.near(m, n, abs(m - n)) and join.near(m, n, difference(s, t))]
                yield batch(schema, {"a": [p for p, _ in ok], "b": [q for _, q in ok]})

        pairs = wide.mapInArrow(screen, "a long, b long").distinct()
    pairs = scratch.table(pairs, f"{name}-pairs")
    nodes = pairs.select(F.col("a").alias("gid")).unionByName(pairs.select(F.col("b").alias("gid"))).distinct()
    wanted = nodes.groupBy(F.shiftright("gid", 16).alias("block")).agg(F.collect_list(F.col("gid").bitwiseAND(0xFFFF).cast("int")).alias("at"))  # at most a block's documents

    def packed(batches):
        for b in batches:
            for block, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield batch(arrow_schema(REPLY), {"block": [block], "kind": [1], "bucket": [0], "payload": [np.array(at, np.uint16).tobytes()]})

    def sets_of(batches):
        schema = arrow_schema("gid long, n long, set binary")
        for block, (_, texts), got in with_replies(batches):
            if 1 in got:
                at = np.sort(np.frombuffer(got[1][0], np.uint16)).tolist()
                found = join.sets([texts[k] for k in at])
                yield batch(schema, {"gid": [block << 16 | k for k in at], "n": [len(s) for s in found], "set": [_narrow(s) for s in found]})

    beside = dealt(table.unionByName(wanted.mapInArrow(packed, REPLY)), "block", table).sortWithinPartitions("block", "kind", "bucket")
    sets = scratch.table(beside.mapInArrow(sets_of, "gid long, n long, set binary"), f"{name}-sets")
    left = sets.select(F.col("gid").alias("a"), F.col("n").alias("n_a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("gid").alias("b"), F.col("n").alias("n_b"), F.col("set").alias("set_b"))

    def exact(batches):
        schema = arrow_schema("a long, b long")
        for b in _sliced(batches):
            x = b.to_pydict()
            ok = []
            for p, q, m, n, s, t in zip(x["a"], x["b"], x["n_a"], x["n_b"], x["set_a"], x["set_b"]):
                both = len(np.intersect1d(_wide(s), _wide(t), assume_unique=True))
                if join.den * both >= join.num * (m + n - both):
                    ok.append((p, q))
            yield batch(schema, {"a": [p for p, _ in ok], "b": [q for _, q in ok]})

    linked = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "set_a", "set_b").mapInArrow(exact, "a long, b long")
    linked = scratch.table(linked, f"{name}-links")
    scratch.drop(f"{name}-pairs", f"{name}-sets")
    return linked


REPLY = "block long, kind int, bucket int, payload binary"


def _cross(large: DataFrame, labels: DataFrame, sketches: DataFrame, rows: DataFrame, join: Join, scratch: Scratch) -> DataFrame | None:
    """Pairs of different components in large groups that the bitmaps don't rule out; None where there is none to test."""
    rep = sketches.select("gid", "rep")
    own = large.join(rep, "gid").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("centre", "rep", F.coalesce("label", "rep").alias("label"))
    own = scratch.table(own.distinct(), "large-labels")
    by_label = own.groupBy("centre", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = by_label.groupBy("centre").agg(F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("size")).where("size > main.n")
    chunks = lambda n: F.ceil(n / F.greatest(F.lit(LEAST_CHUNK), F.least(F.lit(MOST_CHUNK), F.ceil(n / CHUNKS)))).cast("int")
    mixed = mixed.select("centre", F.col("main.label").alias("main"), chunks(F.col("size") - F.col("main.n")).alias("others"), chunks(F.col("main.n")).alias("mains"), "size")
    mixed = scratch.table(mixed, "mixed")
    sent = mixed.agg(F.sum(F.col("size") * (F.col("others") + F.col("mains")))).first()[0]
    if not sent:
        scratch.drop("large-labels", "mixed")
        return None
    fine = rows.select(F.col("gid").alias("rep"), "n", F.col("fine").alias("sketch"))
    some = own.join(mixed, "centre").join(fine, "rep")
    # chunks of what is outside the largest component come first, then its own
    inside, others, mains = F.col("label") == F.col("main"), F.col("others"), F.col("mains")
    some = some.withColumn("k", F.when(inside, others + F.pmod(F.xxhash64("rep"), mains)).otherwise(F.pmod(F.xxhash64("rep"), others)).cast("int"))
    some = some.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(inside, others - 1).otherwise(others + mains - 1))))
    some = some.withColumn("lo", F.least("k", "other")).withColumn("hi", F.greatest("k", "other")).select("centre", "lo", "hi", "k", "rep", "label", "n", "sketch")

    def test(batches):
        schema = arrow_schema("a long, b long")
        for (_, lo, hi), found in itertools.groupby(rows_of(batches), key=lambda r: (r["centre"], r["lo"], r["hi"])):
            rows = list(found)
            a, b = _screen([r for r in rows if r["k"] == lo], [r for r in rows if r["k"] == hi], lo == hi, join)
            if len(a):
                yield batch(schema, {"a": np.minimum(a, b), "b": np.maximum(a, b)})

    tasks = max(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), sent // MOST_CHUNK)
    pairs = some.repartition(tasks, "centre", "lo", "hi").sortWithinPartitions("centre", "lo", "hi").mapInArrow(test, "a long, b long").distinct()
    pairs = scratch.table(pairs, "cross")
    scratch.drop("large-labels", "mixed")
    return pairs


def _screen(left: list[dict], right: list[dict], same: bool, join: Join) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of different labels that can link by their sizes and bitmaps."""
    if not left or not right:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    by_size: dict[int, list[dict]] = {}
    for r in right:
        by_size.setdefault(len(r["sketch"]), []).append(r)
    out_a, out_b = [], []
    for r in left:
        m = r["n"]
        for width, rows in by_size.items():
            if "matrix" not in rows[0]:
                rows[0]["matrix"] = (
                    np.frombuffer(b"".join(x["sketch"] for x in rows), np.uint8).reshape(len(rows), -1),
                    np.array([x["n"] for x in rows]), np.array([x["label"] for x in rows]), np.array([x["rep"] for x in rows]),
                )
            sketch, n, label, rep = rows[0]["matrix"]
            ok = np.flatnonzero((label != r["label"]) & join.near(m, n, np.abs(m - n)))
            if same:
                ok = ok[rep[ok] > r["rep"]]
            if not len(ok):
                continue
            own, theirs = np.frombuffer(r["sketch"], np.uint8), sketch[ok]
            while len(own) > theirs.shape[1]:
                own = own[: len(own) // 2] ^ own[len(own) // 2 :]
            while theirs.shape[1] > len(own):
                half = theirs.shape[1] // 2
                theirs = theirs[:, :half] ^ theirs[:, half:]
            ok = ok[join.near(m, n[ok], np.bitwise_count(theirs ^ own).sum(1, dtype=np.int64))]
            out_a.append(np.full(len(ok), r["rep"]))
            out_b.append(rep[ok])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])
