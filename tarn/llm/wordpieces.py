"""A tokenizer file applied through its own library; a word-level BPE one distinct
white-space-separated string at a time.

Where normaliser and pre-tokenizer are those below, they never look across white
space (``by_strings`` says so of a file), so a text's ids are the ids of its strings
in order; any other file's texts go to the library whole. Splitting is on the six ASCII
white-space characters alone; any other white space stays inside a string, where
the library deals with it. What a string encodes to is kept in a bounded table.
"""

from __future__ import annotations

import array
import json
import os
import re

#: Strings kept in a worker's table before it is emptied.
TABLE_ENTRIES = 400_000


def load(path: str):
    """The library's tokenizer, on the calling thread only."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def by_strings(path: str) -> bool:
    """Whether a text's ids are those of its strings between white space: the file's parts are those that this was shown for."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    model = d["model"]
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    apart = all(not any(t[k] for k in ("single_word", "lstrip", "rstrip", "normalized")) and not re.search(r"\s", t["content"]) for t in d["added_tokens"])
    return plain and apart and (model["type"], model.get("end_of_word_suffix")) == ("BPE", "</w>") and (d["normalizer"], d["pre_tokenizer"]) == (NORMALIZER, PRE_TOKENIZER)


class Whole:
    """Texts through the library, whole: the counts of their ids, or the ids as bytes of ``kind``."""

    def __init__(self, path: str, kind: str | None = None):
        self.tok, self.code = load(path), {"<u2": "H", "<u4": "I"}.get(kind)

    def values(self, texts: list[bytes]) -> list:
        found = (self.tok.encode(t.decode(), add_special_tokens=False).ids for t in texts)
        return [array.array(self.code, ids).tobytes() if self.code else len(ids) for ids in found]


def whole_tokens(path: str) -> dict[bytes, int]:
    """The vocabulary strings that encode alone as one token, with its id, proved by encoding each.

    A string with white space in it is left out, since texts are split there.
    """
    tok = load(path)
    decode = _byte_decoder()
    suffix = "</w>"
    found = []
    for piece, at in tok.get_vocab(with_added_tokens=False).items():
        if piece.endswith(suffix):
            try:
                found.append((bytes(decode[c] for c in piece[: -len(suffix)]).decode(), at))
            except (KeyError, UnicodeDecodeError):
                continue
    encoded = tok.encode_batch([s for s, _ in found], add_special_tokens=False)
    return {s.encode(): at for (s, at), e in zip(found, encoded) if e.ids == [at] and len(s.split()) == 1 and len(s.encode().split()) == 1}


def _byte_decoder() -> dict[str, int]:
    """The printable character of byte-level BPE for each byte, reversed: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


#: Strings of printable Latin-1 characters: composed already, and lower-cased alike everywhere.
PLAIN = re.compile(rb"(?:[\x21-\x7e]|\xc2[\xa1-\xbf]|\xc3[\x80-\xbf])+").fullmatch
#: The pre-token pattern, normaliser and pre-tokenizer of such a file (fixed values).
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": PRE_TOKENS}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}


class WordTable:
    """String -> count of its ids, or its ids as bytes of ``kind`` (little-endian, as every machine that Spark runs on is).

    What is missing is added when it is met: a plain string is cut into
    pre-tokens, proven whole tokens count as they are and the model merges the
    others; any other string goes to the library whole.
    """

    def __init__(self, path: str, proven: dict[bytes, int], kind: str | None = None):
        import regex

        self.tok, self.kind = load(path), kind
        self.merge = self.tok.model.tokenize
        self.pieces = regex.compile(PRE_TOKENS).findall
        self.bytes = {b: c for c, b in _byte_decoder().items()}
        self.special = re.compile(b"|".join(re.escape(t.content.encode()) for t in self.tok.get_added_tokens_decoder().values()) or b"(?!)").search
        self.code = {"<u2": "H", "<u4": "I"}.get(kind)
        self.join = b"".join if kind else sum
        self.start = {w: self._value([at]) for w, at in proven.items()}
        self.whole = {w.decode(): v for w, v in self.start.items()}
        self._empty()

    def _empty(self) -> None:
        self.table, self.known = _Table(self.start, self._encoded), dict(self.whole)

    def _value(self, ids: list[int]):
        return array.array(self.code, ids).tobytes() if self.kind else len(ids)

    def _merged(self, p: str):
        at = self.bytes
        found = self.merge(p if p.isascii() else "".join([at[b] for b in p.encode()]))
        self.known[p] = v = self._value([t.id for t in found]) if self.kind else len(found)
        return v

    def _encoded(self, s: bytes):
        """A string's value; letters alone, or with one mark after them, are pre-tokens as they stand."""
        if s.isalpha():
            p = s.decode().lower()
            return self.known.get(p) or self._merged(p)
        if s[:-1].isalpha() and s[-1] in b".,;:!?|":
            p, mark = s[:-1].decode().lower(), chr(s[-1])
            return (self.known.get(p) or self._merged(p)) + (self.known.get(mark) or self._merged(mark))
        if PLAIN(s) and not self.special(s):
            get, merged = self.known.get, self._merged
            return self.join([get(p) or merged(p) for p in self.pieces(s.decode().lower())])
        return self._value(self.tok.encode(s.decode(), add_special_tokens=False).ids)

    def values(self, texts: list[bytes]) -> list:
        """Of each text: the count of its ids, or their bytes."""
        get = self.lookup()
        return [self.join(map(get, t.split())) for t in texts]

    def lookup(self):
        """string -> value, for a unit of texts."""
        if len(self.table) > TABLE_ENTRIES + len(self.start):
            self._empty()
        return self.table.__getitem__


class _Table(dict):
    """A dict that encodes what it lacks."""

    def __init__(self, start: dict, encoded):
        super().__init__(start)
        self.encoded = encoded

    def __missing__(self, s: bytes):
        self[s] = v = self.encoded(s)
        return v
