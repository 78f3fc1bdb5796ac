"""SentencePiece encoding and decoding with a max-plus scan for giant documents.

The public model is a BPE model, for which the best sum of piece scores is not
the encoding. What is: of all ways to cut a text into pieces exactly one has
every two neighbours compatible, that is, the two pieces' joined text encodes to
just these two; and it is the library's encoding. So the scan runs over path
weights 0 (compatible) and minus infinity, and its results equal the library's.

A giant document is cut into chunks at fixed places. The state at a cut is the
piece that covers it or ends there. A chunk yields its transfer matrix from the
states at its left cut to those at its right one; matrices are combined
associatively in the max-plus semiring, which fixes the state at every cut; each
chunk is then traced back alone.

No piece holds a blank after another character, so the encoding splits before
every run of blanks. Inside a chunk the stretch between its first and last such
place is encoded from a table of units; only what lies outside (the whole chunk,
where there is none) goes through the lattice. Ordinary documents consist of
units alone.

Null texts count as empty: no ids. U+2581 in a text is a blank to the model and
decodes to one. Repeated rows are encoded each; empty tables give no rows; extra
columns are ignored.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.shared import Scratch, arrow_schema, batch, map_units, pick, rows_of, ship

#: Characters beyond which a document is giant, and of its chunks.
GIANT, CHUNK = 1 << 15, 1 << 13
#: Units kept in a worker's table before it is emptied.
TABLE_ENTRIES = 120_000
BLANK = "▁"
MINUS = np.float32(-np.inf)


class Codec:
    """The model's library, with a table of units and of compatible neighbours."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.lib.get_piece_size()
        pieces = [self.lib.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (self.lib.is_byte(i) or self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_unused(i))]
        self.id = {pieces[i]: i for i in plain}
        self.longest = max(map(len, self.id))
        if any(BLANK in p.lstrip(BLANK) for p in self.id):
            raise ValueError("a piece of this model crosses from a character to a blank")
        self.wall = next(c for c in "\n\x01\x02\x03" if c not in self.id)  # merges with nothing
        self.raw = [b""] * n
        for i in range(n):
            if self.lib.is_byte(i):
                self.raw[i] = int(pieces[i][3:5], 16).to_bytes(1, "big")
        for p, i in self.id.items():
            self.raw[i] = p.replace(BLANK, " ").encode()
        self.width = "<u2" if n <= 1 << 16 else "<u4"
        self.table: dict[str, bytes] = {}
        self.fits: dict[tuple[str, str], bool] = {}

    # units

    def bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, self.width).tobytes()

    def learn(self, units: set[str]) -> dict[str, bytes]:
        """The table with these units in it; a unit is written without its first blank."""
        if len(self.table) > TABLE_ENTRIES:
            self.table = {}
        new = [u for u in units if u not in self.table]
        for k in range(0, len(new), 8192):
            some = new[k : k + 8192]
            self.table.update(zip(some, map(self.bytes, self.lib.encode(some, num_threads=1))))
        if "" in units:
            self.table[""] = self.bytes([self.id[BLANK]])  # the library gives nothing for an empty text
        return self.table

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of ordinary documents, as bytes."""
        parts = [split(t) for t in texts]
        get = self.learn(set().union(*parts)).__getitem__
        return [b"".join(map(get, p)) for p in parts]

    def decode(self, ids: bytes) -> str:
        raw = self.raw
        return b"".join([raw[i] for i in np.frombuffer(ids, self.width).tolist()]).decode(errors="replace")[1:]

    # lattice

    def pieces_of(self, s: str) -> list[str]:
        """The library's encoding of a string with blanks as U+2581, with no blank put before it."""
        return [self.lib.id_to_piece(i) for i in self.lib.encode(self.wall + s.replace(BLANK, " "))[2:]]

    def compatible(self, a: str, b: str) -> bool:
        if a not in self.id or b not in self.id:
            return True  # a character outside the vocabulary merges with nothing
        if (a, b) not in self.fits:
            if len(self.fits) > TABLE_ENTRIES:
                self.fits = {}
            self.fits[a, b] = self.pieces_of(a + b) == [a, b]
        return self.fits[a, b]

    def alone(self, a: str) -> bool:
        """Whether a piece encodes to itself."""
        if a not in self.id:
            return len(a) == 1
        if (a, "") not in self.fits:
            self.fits[a, ""] = self.pieces_of(a) == [a]
        return self.fits[a, ""]

    def states(self, text: str, cut: int) -> list[tuple[int, int]]:
        """(first, end) of the pieces in ``text`` that cover ``cut`` or end there."""
        out = []
        for a in range(max(0, cut - self.longest), cut):
            for b in range(cut, min(len(text), a + self.longest) + 1):
                if b > a and self.alone(text[a:b]):
                    out.append((a, b))
        return out

    def lattice(self, text: str, starts: list[tuple[int, int]], goal: int) -> dict[tuple[int, int], tuple[frozenset, list]]:
        """Pieces reachable from the pieces ``starts`` by compatible neighbours, until they reach ``goal``: the numbers of the starts, and the neighbours before."""
        found: dict[tuple[int, int], tuple[set, list]] = {}
        at: dict[int, list[tuple[int, int]]] = {}
        for k, s in enumerate(starts):
            found[s] = ({k}, [])
            at.setdefault(s[1], []).append(s)
        for p in range(min(at, default=goal), goal):
            for here in at.get(p, ()):
                left = text[here[0] : here[1]]
                for q in range(p + 1, min(len(text), p + self.longest) + 1):
                    right = text[p:q]
                    if not self.alone(right):
                        continue
                    if self.compatible(left, right):
                        node = (p, q)
                        if node not in found:
                            found[node] = (set(), [])
                            at.setdefault(q, []).append(node)
                        found[node][0].update(found[here][0])
                        found[node][1].append(here)
        return found

    def trace(self, text: str, start: tuple[int, int], goal: tuple[int, int]) -> list[str]:
        """The pieces after ``start`` up to ``goal``, which ends it."""
        found = self.lattice(text, [start], max(goal[0] + 1, start[1]))
        path, node = [], goal
        while node != start:
            path.append(text[node[0] : node[1]])
            node = found[node][1][0]
        return path[::-1]

    def ids_of(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            out += [self.id[p]] if p in self.id else [self.lib.piece_to_id(f"<0x{b:02X}>") for b in p.encode()]
        return out


def split(text: str) -> list[str]:
    """The units of a text, each without the first of the blanks before it."""
    if not text:
        return []
    parts = text.replace(BLANK, " ").split(" ")
    if "" not in parts:
        return parts
    out, held = [], 0
    for p in parts[:-1]:
        if p:
            out.append(" " * held + p)
            held = 0
        else:
            held += 1
    last = " " * held + parts[-1]
    return [*out, last]


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """This worker's codec; it outlives tasks."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


class Chunk:
    """A chunk of a giant document: its text with ``left`` characters of context before it, and ``right`` after it."""

    def __init__(self, c: Codec, text: str, left: int, right: int):
        self.c, self.text, self.a, self.b = c, text, left, len(text) - right
        self.into = c.states(text, self.a) if left else [(0, 0)]
        out = c.states(text, self.b)
        self.out = out if right else [s for s in out if s[1] == self.b]
        walls = [w for w in range(self.a + 1, self.b) if text[w] == BLANK != text[w - 1]]
        self.walls = (walls[0], walls[-1]) if walls else None

    def matrix(self) -> np.ndarray:
        """Max-plus transfer matrix: 0 where a compatible path joins a state at the left to one at the right."""
        m = np.full((len(self.into), len(self.out)), MINUS, np.float32)
        if self.walls:
            first, last = self.walls
            head = self.c.lattice(self.text, self.into, first)
            rows = sorted(set().union(*(got for (_, q), (got, _) in head.items() if q == first)))
            tail = self.c.lattice(self.text, [(last, last)], self.b)
            for k, e in enumerate(self.out):
                if e in tail:
                    m[rows, k] = 0
        else:
            found = self.c.lattice(self.text, self.into, self.b)
            for k, e in enumerate(self.out):
                if e in found:
                    m[sorted(found[e][0]), k] = 0
        return m

    def trace(self, start: int, goal: int) -> bytes:
        """Ids of the pieces that begin in the chunk, given the states at its cuts."""
        s, e = self.into[start], self.out[goal]
        c, text = self.c, self.text
        if not self.walls:
            return c.bytes(c.ids_of(c.trace(text, s, e)))
        first, last = self.walls
        head = c.lattice(text, [s], first)
        pieces = c.trace(text, s, next(n for n in head if n[1] == first))
        units = split(text[first + 1 : last].replace(BLANK, " ")) if last > first else []
        middle = b"".join(map(c.learn(set(units)).__getitem__, units))
        return c.bytes(c.ids_of(pieces)) + middle + c.bytes(c.ids_of(c.trace(text, (last, last), e)))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of transfer matrices in the max-plus semiring."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def scan(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """States (at the left, at the right) of every chunk on the one path through all of them.

    Prefix products by doubling: after round k each entry is the product of up
    to 2**k matrices, so the combinations of a round don't depend on another.
    """
    prefix, step = list(matrices), 1
    while step < len(prefix):
        prefix = [combine(prefix[k - step], m) if k >= step else m for k, m in enumerate(prefix)]
        step *= 2
    states, right = [], int(prefix[-1][0].argmax())
    for k in reversed(range(len(matrices))):
        before = prefix[k - 1][0] if k else np.zeros(1, np.float32)
        left = int((before + matrices[k][:, right]).argmax())
        if not np.isfinite(before[left] + matrices[k][left, right]):
            raise ValueError("no compatible path")
        states.append((left, right))
        right = left
    return states[::-1]


def chunks(text: str, context: int) -> list[tuple[str, int, int]]:
    """(text with context, left, right) of each chunk of a giant document, blanks as U+2581."""
    full = BLANK + text.replace(" ", BLANK)
    out = []
    for a in range(0, len(full), CHUNK):
        b = min(len(full), a + CHUNK)
        lo, hi = max(0, a - context), min(len(full), b + context)
        out.append((full[lo:hi], a - lo, hi - b))
    return out


PIECES = "gid long, doc_id long, k int, text string, left int, right int"
ENCODED = "doc_id long, n_tokens long, ids_crc32 long, decoded boolean, ids binary"


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), decoded (the ids decode to the text again) and ids (bytes, 16 bits an id where the vocabulary allows) of every row."""
    spark = docs.sparkSession
    ship(spark)
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def described(ids: list, texts: list[str], found: list[bytes]) -> dict:
        c = codec(model)
        arrays = [np.frombuffer(x, c.width) for x in found]
        return {
            "doc_id": ids, "n_tokens": [len(x) for x in arrays], "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in arrays],
            "decoded": [c.decode(x) == t.replace(BLANK, " ") for x, t in zip(found, texts)], "ids": found,
        }

    def ordinary(rest, texts):
        said = [t.decode() for t in texts]
        return described(rest["doc_id"], said, codec(model).encode(said))

    is_giant = F.char_length("text") > GIANT
    small = map_units(rows.where(~is_giant), ENCODED, ordinary)

    scratch = Scratch(spark, "pieces")
    giant = rows.where(is_giant).withColumn("gid", F.monotonically_increasing_id())

    def cut(batches):
        schema = arrow_schema(PIECES)
        context = codec(model).longest
        for r in rows_of(batches):
            for k, (text, left, right) in enumerate(chunks(r["text"], context)):
                yield batch(schema, {"gid": [r["gid"]], "doc_id": [r["doc_id"]], "k": [k], "text": [text], "left": [left], "right": [right]})

    table = scratch.table(giant.mapInArrow(cut, PIECES), "chunks")

    def matrices(batches):
        schema = arrow_schema("gid long, k int, rows int, matrix binary")
        for r in rows_of(batches):
            m = Chunk(codec(model), r["text"], r["left"], r["right"]).matrix()
            yield batch(schema, {"gid": [r["gid"]], "k": [r["k"]], "rows": [len(m)], "matrix": [m.tobytes()]})

    def states(batches):
        schema = arrow_schema("gid long, k int, start int, goal int")
        for gid, found in itertools.groupby(rows_of(batches), key=lambda r: r["gid"]):
            path = scan([np.frombuffer(r["matrix"], np.float32).reshape(r["rows"], -1) for r in found])
            yield batch(schema, {"gid": [gid] * len(path), "k": list(range(len(path))), "start": [a for a, _ in path], "goal": [b for _, b in path]})

    path = table.select("gid", "k", "text", "left", "right").mapInArrow(matrices, "gid long, k int, rows int, matrix binary")
    path = path.repartition("gid").sortWithinPartitions("gid", "k").mapInArrow(states, "gid long, k int, start int, goal int")
    path = scratch.table(path, "path")

    def traced(batches):
        schema = arrow_schema("gid long, doc_id long, k int, body string, ids binary")
        for r in rows_of(batches):
            c = Chunk(codec(model), r["text"], r["left"], r["right"])
            yield batch(schema, {"gid": [r["gid"]], "doc_id": [r["doc_id"]], "k": [r["k"]], "body": [r["text"][c.a : c.b]], "ids": [c.trace(r["start"], r["goal"])]})

    def joined(batches):
        schema = arrow_schema(ENCODED)
        for (_, doc_id), found in itertools.groupby(rows_of(batches), key=lambda r: (r["gid"], r["doc_id"])):
            got = list(found)
            text = "".join(r["body"] for r in got)[1:].replace(BLANK, " ")
            yield batch(schema, described([doc_id], [text], [b"".join(r["ids"] for r in got)]))

    parts = table.join(path, ["gid", "k"]).select("gid", "doc_id", "k", "text", "left", "right", "start", "goal").mapInArrow(traced, "gid long, doc_id long, k int, body string, ids binary")
    large = parts.repartition("gid").sortWithinPartitions("gid", "k").mapInArrow(joined, ENCODED)
    return small.unionByName(large)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text from doc_id and ids."""
    ship(encoded.sparkSession)
    schema = arrow_schema("doc_id long, text string")

    def run(batches):
        for b in batches:
            yield batch(schema, {"doc_id": b.column(0), "text": [codec(model).decode(x or b"") for x in b.column(1).to_pylist()]})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
