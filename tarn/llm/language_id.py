"""Language identification with spans.

Fitting counts hashed byte 3- and 4-grams of words and the scripts of letters in
each language, over a sample of at most about ``PER_LANGUAGE`` labelled documents
a language (chosen by a hash of doc_id; the only bound in this operator).

A word's script narrows the languages it may belong to (all, where none uses it);
letters outside SCRIPTS have a script bit of their own. Only for these candidates
is it scored, by the smoothed log-probability of its n-grams; any other language
has the lowest of these scores less FOREIGN. A Viterbi pass with a
penalty for switching labels the words of the whole text, all documents of a
unit in step. A very long text is labelled whole by one task, which holds a number
for each word and language. A text's language is the one that most of its lettered words are
labelled with, and its score their share.

``und`` with score 0 goes to null texts, to texts without a letter, and to all
texts where nothing could be learned. Ties go to the language first in name
order. Repeated rows are judged each; rows without a doc_id are judged, and neither
learned from nor held out; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.shared import arrow_schema, batch, filter_units, map_units, pick, ship, units

#: Labelled documents that a language is learned from, in expectation at most.
PER_LANGUAGE = 4000
BITS = 16
SMOOTHING = 0.5
#: Log-probability that a switch of language costs.
SWITCH = 10.0
#: What a word loses in a language that doesn't use its script.
FOREIGN = 30.0
#: A language uses a script in which at least this share of its letters is.
SCRIPT_SHARE = 0.01
#: Scores of a unit: words times languages.
UNIT = 16 << 20

#: Scripts and their ranges of code points (fixed values of the Unicode standard).
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)],
    "oriya": [(0xB00, 0xB7F)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)],
    "malayalam": [(0xD00, 0xD7F)],
    "sinhala": [(0xD80, 0xDFF)],
    "thai": [(0xE00, 0xE7F)],
    "lao": [(0xE80, 0xEFF)],
    "tibetan": [(0xF00, 0xFFF)],
    "burmese": [(0x1000, 0x109F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "ethiopic": [(0x1200, 0x137F)],
    "khmer": [(0x1780, 0x17FF)],
    "mongolian": [(0x1800, 0x18AF)],
    "hiragana": [(0x3040, 0x309F)],
    "katakana": [(0x30A0, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
}
#: Script bit of letters that none of SCRIPTS has, and the number of script bits.
OTHER, N_SCRIPTS = len(SCRIPTS), len(SCRIPTS) + 1


def _script_table() -> np.ndarray:
    """Bit of the script for the first two bytes of a character (first byte alone for ASCII)."""
    table = np.zeros((256, 256), np.uint32)
    for bit, ranges in enumerate(SCRIPTS.values()):
        for a, b in ranges:
            for c in {*range(a, b + 1, 32), b} if a > 0x7F else range(a, b + 1):
                raw = chr(c).encode() if not 0xD800 <= c < 0xE000 else b""
                if len(raw) == 1:
                    table[raw[0], :] |= 1 << bit
                elif raw:
                    table[raw[0], raw[1]] |= 1 << bit
    return table.reshape(-1)


_TABLE = _script_table()
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def _grams(piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased bytes: word starts and ends, the word bytes' 3-gram and 4-gram numbers, the words' script bits."""
    on = _WORD[piece]
    m = np.where(on, piece, 32).astype(np.uint32)
    pad = np.concatenate(([32], m, [32, 32])).astype(np.uint32)
    three = (pad[:-3] * np.uint32(0x01000193) ^ pad[1:-2]) * np.uint32(0x01000193) ^ pad[2:-1]
    four = three * np.uint32(0x01000193) ^ pad[3:]
    three, four = (((x * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)) for x in (three, four))
    edge = np.flatnonzero(np.diff(np.concatenate(([False], on, [False]))))
    start, end = edge[0::2], edge[1::2]
    bits = _TABLE[(m << np.uint32(8)) | pad[2:-1]]
    script = np.bitwise_or.reduceat(bits, start) if len(start) else np.zeros(0, np.uint32)
    # reduceat runs to the next word's start; bytes between words are blanks without a script
    if len(start):
        for k in np.flatnonzero((script == 0) & (np.maximum.reduceat(m, start) > 127)):
            if _has_letter(piece[start[k] : end[k]].tobytes().decode()):
                script[k] = 1 << OTHER
    return start, end, three[on], four[on], script


def _pieces(texts: list[str]):
    """(first and last document, bytes, byte offsets of documents) of lower-cased texts, some 100 KB at a time."""
    at = size = 0
    low = [t.lower().encode() for t in texts]
    for k, t in enumerate(low):
        size += len(t) + 1
        if size >= 1 << 17 or k + 1 == len(low):
            part = low[at : k + 1]
            yield at, k + 1, np.frombuffer(b" ".join(part) + b" ", np.uint8), np.cumsum([0] + [len(x) + 1 for x in part])
            at, size = k + 1, 0


@dataclass
class Model:
    languages: list[str]
    three: np.ndarray  # (2**BITS, languages) float32
    four: np.ndarray
    scripts: np.ndarray  # bits of each language

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of all words, whether each has a letter, and the documents' bounds."""
        scores, lettered, counts = [np.zeros((0, len(self.languages)), np.float32)], [np.zeros(0, bool)], []
        for _, _, piece, offsets in _pieces(texts):
            start, end, three, four, script = _grams(piece)
            counts.append(np.diff(np.searchsorted(start, offsets)))
            if not len(start):
                continue
            letter = script > 0
            s = np.zeros((len(start), len(self.languages)), np.float32)
            for bits in np.unique(script[letter]):
                own = np.flatnonzero(script == bits)
                s[own] = self._candidates(bits, own, end - start, three, four)
            scores.append(s)
            lettered.append(letter)
        return np.concatenate(scores), np.concatenate(lettered), np.concatenate(([0], np.cumsum(np.concatenate(counts)))) if counts else np.zeros(1, np.int64)

    def _candidates(self, bits: int, own: np.ndarray, n: np.ndarray, three: np.ndarray, four: np.ndarray) -> np.ndarray:
        """Scores of the words ``own``, all of the scripts ``bits``; of all words' sizes ``n`` and their bytes' n-grams."""
        fits = np.flatnonzero((self.scripts & bits) > 0)
        fits = fits if len(fits) else np.arange(len(self.languages))
        first, size = (np.cumsum(n) - n)[own], n[own]
        at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
        if len(fits) == len(self.languages):
            each = self.three[three[at]] + self.four[four[at]]
        else:
            each = self.three[three[at][:, None], fits] + self.four[four[at][:, None], fits]
        scored = np.add.reduceat(each, np.cumsum(size) - size, axis=0) / 2
        out = np.repeat(scored.min(1, keepdims=True) - np.float32(FOREIGN), len(self.languages), axis=1)
        out[:, fits] = scored
        return out

    def label(self, scores: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Viterbi labels of all words, all documents in step, longest first."""
        size = np.diff(bounds)
        order = np.argsort(-size, kind="stable")
        first, size = bounds[:-1][order], size[order]
        steps = int(size[0]) if len(size) else 0
        active = np.searchsorted(-size, -np.arange(1, steps + 1), "right")  # documents with more than t words
        total, n = len(scores), len(self.languages)
        came, switch = np.zeros(total, np.uint16), np.zeros((total, n), bool)
        v = np.zeros((len(size), n), np.float32)
        for t in range(steps):
            k = active[t]
            at = first[:k] + t
            now = v[:k]
            if t:
                best = now.argmax(1)
                jump = now.max(1) - np.float32(SWITCH)
                came[at] = best
                take = jump[:, None] > now
                switch[at] = take
                now = np.where(take, jump[:, None], now)
            v[:k] = now + scores[at]
        labels = np.zeros(total, np.uint16)
        state = v.argmax(1)
        for t in reversed(range(steps)):
            k = active[t]
            at = first[:k] + t
            now = state[:k]
            labels[at] = now
            state[:k] = np.where(switch[at, now], came[at], now)
        return labels


def _held_out(modulus: int, remainder: int):
    return F.crc32(F.col("doc_id").cast("string")) % modulus == remainder


def fit(labelled: DataFrame) -> Model:
    """A model from the text and lang of labelled documents."""
    spark = labelled.sparkSession
    ship(spark)
    rows = pick(labelled, "doc_id", "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    count = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(count)
    number = {x: k for k, x in enumerate(languages)}
    share = F.create_map(*(F.lit(x) for lang in languages for x in (lang, min(1.0, PER_LANGUAGE / count[lang])))) if languages else None
    size, n_scripts = 1 << BITS, N_SCRIPTS
    ddl = "lang string, three binary, four binary, scripts binary"
    schema = arrow_schema(ddl)

    def counts(batches):
        found = {}
        for rest, texts in units(batches):
            for lang in set(rest["lang"]):
                got = found.setdefault(lang, [np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(n_scripts, np.int64)])
                for _, _, piece, _ in _pieces([t.decode() for t, x in zip(texts, rest["lang"]) if x == lang]):
                    _, _, three, four, script = _grams(piece)
                    got[0] += np.bincount(three, minlength=size)
                    got[1] += np.bincount(four, minlength=size)
                    got[2] += [int(((script >> np.uint32(k)) & np.uint32(1)).sum()) for k in range(n_scripts)]
        for lang, got in found.items():
            yield batch(schema, {"lang": [lang], "three": [got[0].tobytes()], "four": [got[1].tobytes()], "scripts": [got[2].tobytes()]})

    def added(batches):
        total = {}
        for b in batches:
            for r in b.to_pylist():
                own = total.setdefault(r["lang"], [0, 0, 0])
                for k, name in enumerate(("three", "four", "scripts")):
                    own[k] = own[k] + np.frombuffer(r[name], np.int64)
        for lang, got in total.items():
            yield batch(schema, {"lang": [lang], "three": [got[0].tobytes()], "four": [got[1].tobytes()], "scripts": [got[2].tobytes()]})

    three, four = np.zeros((size, len(languages))), np.zeros((size, len(languages)))
    scripts = np.zeros((len(languages), n_scripts))
    if languages:
        chosen = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).select("text", "lang")
        for r in chosen.mapInArrow(counts, ddl).repartition("lang").mapInArrow(added, ddl).toLocalIterator():
            k = number[r["lang"]]
            three[:, k], four[:, k] = np.frombuffer(r["three"], np.int64), np.frombuffer(r["four"], np.int64)
            scripts[k] = np.frombuffer(r["scripts"], np.int64)
    logs = [np.log((x + SMOOTHING) / (x.sum(0) + SMOOTHING * size)).astype(np.float32) for x in (three, four)]
    uses = scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(1))[:, None]
    return Model(languages, *logs, (uses * (1 << np.arange(n_scripts))).sum(1).astype(np.uint32))


_LETTER = None


def _has_letter(text: str) -> bool:
    global _LETTER
    if _LETTER is None:
        import regex

        _LETTER = regex.compile(r"\p{L}").search
    return _LETTER(text) is not None


def predict(m: Model, texts: list[bytes], spans: bool = False) -> dict:
    """lang_pred, score and, if asked for, spans of texts."""
    names, n = [*m.languages, "und"], len(texts)
    if not m.languages:
        return {"lang_pred": ["und"] * n, "score": [0.0] * n, "spans": [[]] * n}
    said = [t.decode() for t in texts]
    scores, lettered, bounds = m.words(said)
    labels = m.label(scores, bounds)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    votes = np.bincount(doc[lettered] * len(m.languages) + labels[lettered], minlength=n * len(m.languages)).reshape(n, -1)
    all_ = votes.sum(1)
    best = votes.argmax(1)
    has = np.array([_has_letter(t) for t in said], bool)
    score = np.where(has & (all_ > 0), votes.max(1) / np.maximum(1, all_), 0.0)
    out = {"lang_pred": [names[b] if h else "und" for b, h in zip(best, has)], "score": score}
    if spans:
        out["spans"] = [_spans(labels[a:b], names) if h else [] for a, b, h in zip(bounds[:-1], bounds[1:], has)]
    return out


def _limit(model: Model) -> int:
    return max(1 << 19, UNIT // max(4, len(model.languages)))


def identify(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """doc_id, lang_pred, score of every document; with ``spans``, also the labelled spans of each text as "first:end:language" over its words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 512 KB a language
    ddl = "doc_id long, lang_pred string, score double" + ", spans array<string>" * spans

    def work(rest, texts):
        return {"doc_id": rest["doc_id"]} | predict(shared.value, texts, spans)

    return map_units(pick(docs, "doc_id", "text"), ddl, work, limit=_limit(model))


def recognised(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose language is not ``und``, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 512 KB a language

    def keep(texts):
        return [x != "und" for x in predict(shared.value, texts)["lang_pred"]]

    return filter_units(docs, keep, limit=_limit(model))


def _spans(labels: np.ndarray, names: list[str]) -> list[str]:
    if not len(labels):
        return []
    new = np.flatnonzero(np.concatenate(([True], labels[1:] != labels[:-1])))
    return [f"{a}:{b}:{names[labels[a]]}" for a, b in zip(new, [*new[1:], len(labels)])]


def learn(docs: DataFrame, modulus: int = 4, remainder: int = 2) -> Model:
    """A model from the documents that are not held out."""
    return fit(docs.where(~_held_out(modulus, remainder)))


def language_id(docs: DataFrame, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """Learn from documents whose crc32(doc_id) modulo ``modulus`` is not ``remainder``; doc_id, held_out, lang_pred, score and spans of all."""
    model = learn(docs, modulus, remainder)
    return identify(docs, model, spans=True).select("doc_id", F.coalesce(_held_out(modulus, remainder), F.lit(False)).alias("held_out"), "lang_pred", "score", "spans")
