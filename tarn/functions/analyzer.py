"""Analyzers: how text becomes index terms.

``simple`` lower-cases and keeps runs of letters and digits, all in the JVM.
``porter`` also folds diacritics and applies Porter's suffix stripping (M. F.
Porter, 1980), once for each distinct word of an Arrow batch.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from tarn.functions.text import tokens


def folded(word: str) -> str:
    """Without diacritics."""
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


def _shape(stem: str) -> str:
    """c and v for consonants and vowels; y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(stem):
        out += "v" if c in "aeiou" or (c == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short(stem: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


#: Suffixes of Porter's steps 2 to 4 and what replaces them (fixed values of the algorithm).
STEP_2 = "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log"
STEP_3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _swap(word: str, rules: str) -> str:
    pairs = sorted((r.split(":") for r in rules.split()), key=lambda r: -len(r[0]))
    for suffix, new in pairs:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + new if _measure(stem) > 0 else word
    return word


@lru_cache(100_000)
def stem(word: str) -> str:
    """Porter's stem of a lower-case word; words of one or two letters, or with other characters than a to z, stay."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    cut = next((len(x) for x in ("ed", "ing") if word.endswith(x)), 0)
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    elif cut and "v" in _shape(word[:-cut]):
        word = word[:-cut]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short(word):
            word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, STEP_2), STEP_3)
    for suffix in sorted(STEP_4.split(), key=len, reverse=True):
        if word.endswith(suffix):
            rest = word[: -len(suffix)]
            if _measure(rest) > 1 and (suffix != "ion" or rest[-1:] in ("s", "t")):
                word = rest
            break
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def term(word: str, analyzer: str) -> str:
    """One query word as the index has it."""
    word = word.lower()
    return stem(folded(word)) if analyzer == "porter" else word


def certain(stem_: str) -> str:
    """What a lower-case word of ASCII letters and digits begins with if its Porter stem is, or begins with, ``stem_``: steps replace the end of a word, and of a replaced end at most the last two letters are not the word's own (bl-e for b-iliti, i for y)."""
    return stem_[:-2] if re.fullmatch("[a-z]+", stem_) else re.match("[a-z0-9]*", stem_)[0]


def stems(words: Column, analyzer: str) -> Column:
    """The terms of words as ``tokens`` gives them."""
    return F.arrow_udf(stemmed, "array<string>")(words) if analyzer == "porter" else words


def terms(text: Column, analyzer: str = "simple") -> Column:
    """The terms of a text, in order."""
    found = tokens(F.coalesce(text, F.lit("")))
    if analyzer == "simple":
        return found
    if analyzer != "porter":
        raise ValueError(f"unknown analyzer: {analyzer}")

    return F.arrow_udf(stemmed, "array<string>")(found)


def stemmed(words: pa.Array) -> pa.Array:
    """The stems of arrays of words: each distinct word of a batch is stemmed once, all else is done on dictionary codes."""
    flat = words.flatten().dictionary_encode()
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.combine_chunks()
    stems = pa.array([stem(folded(w)) for w in flat.dictionary.to_pylist()], pa.string())
    sizes = pc.fill_null(pc.list_value_length(words), 0)
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(sizes).cast(pa.int32())])
    return pa.ListArray.from_arrays(offsets, stems.take(flat.indices))
