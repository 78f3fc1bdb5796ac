"""Where the constructs of source files start: classes, functions, methods, types, imports.

A file is cut into tokens by one pattern a language, which knows its strings and
comments; brackets are paired with a stack. A construct is a keyword where a
statement may start, told from the same word elsewhere by the tokens around it and
by what the innermost bracket is (a class' body, an object, a macro's arguments).
Files that aren't whole give what can be told of them, never an error. Python files
go through the standard library's parser, and give nothing where that fails.

Offsets are code points. Null and empty bodies, and files of other languages, have
no constructs. A file is one row: a very long one is scanned in one task, in memory,
and if it is well formed in time, proportional to its length.
"""

from __future__ import annotations

import ast as python_ast
import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions import paths as P
from tarn.functions.pieces import by_pieces

#: Scores of constructs (fixed values).
SCORES = {"class": 100, "iface": 100, "struct": 100, "trait": 100, "impl": 100, "mod": 100, "export": 90, "func": 90, "method": 90, "decorated": 90, "type": 80, "enum": 80, "import": 60}

#: Languages by extension (fixed values; ``functions.paths.language_of`` as a column).
FAMILIES = {"typescript": "script", "tsx": "script", "javascript": "script", "go": "go", "rust": "rust", "python": "python"}

_LINE, _BLOCK = r"//[^\n]*", r"/\*(?s:.*?)(?:\*/|\Z)"
_QUOTED = r'"(?:\\(?s:.)|[^"\\\n])*"?'
_OTHER = r"=>|->|::|\s+|\d[\w.]*|(?s:.)"
#: Tokens of a language: comments, texts, words, the rest.
TOKENS = {
    "script": re.compile(rf"(?P<skip>{_LINE}|{_BLOCK})|(?P<text>{_QUOTED}|'(?:\\(?s:.)|[^'\\\n])*'?)|(?P<word>[#$\w][$\w]*)|{_OTHER}"),
    "go": re.compile(rf"(?P<skip>{_LINE}|{_BLOCK})|(?P<text>{_QUOTED}|`[^`]*`?|'(?:\\.|[^'\\\n])+')|(?P<word>[^\W\d]\w*)|{_OTHER}"),
    "rust": re.compile(
        rf"(?P<skip>{_LINE})|(?P<text>b?r(?P<hashes>#*)\"(?s:.*?)(?:\"(?P=hashes)|\Z)|b?\"(?:\\(?s:.)|[^\"\\])*\"?|b?'(?:\\[^\n']+|\\'|[^'\\\n])')|(?P<word>'\w+|r#\w+|[^\W\d]\w*)|{_OTHER}"
    ),
}
#: A slash after one of these begins a pattern, not a division.
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_BEFORE_REGEX = set("( , = : [ ! & | ? { } ; + - * % ~ ^ =>".split()) | {"return", "typeof", "case", "in", "of", "do", "else", "void", "delete", "throw", "new", ""}
_TEMPLATE = re.compile(r"(?s:\\.|\$(?!\{)|[^\\`$])*")
_COMMENT_ENDS = re.compile(r"/\*|\*/")
_PAIRS = {")": "(", "]": "[", "}": "{"}
#: A line that begins after one of these goes on.
_GOES_ON = set("( , = : [ ! & | ? + - * / % ~ ^ < . => extends implements".split())
_SCRIPT_MODIFIERS = {"public", "private", "protected", "static", "override", "readonly", "async", "get", "set", "declare", "accessor"}
_RUST_MODIFIERS = {"pub", "async", "unsafe", "const", "extern", "default"}
_RUST_KINDS = {"struct": "struct", "impl": "impl", "fn": "func", "trait": "trait", "enum": "enum", "use": "import", "type": "type", "mod": "mod"}


class Construct(NamedTuple):
    pos: int
    kind: str
    name: str | None


class Source:
    """A file's tokens: ``text``, ``at``, ``line`` (a line break before it), ``inside`` (the bracket around it, -1 for none), ``close`` (a bracket's partner)."""

    def __init__(self, body: str, family: str):
        self.text: list[str] = []
        self.at: list[int] = []
        self.line: list[bool] = []
        self.inside: list[int] = []
        self.close: dict[int, int] = {}
        self.opener: dict[int, int] = {}
        self.words: set[int] = set()
        self._open: list[int] = []
        self._waiting = {"(": 0, "[": 0, "{": 0}
        self._broken = False
        pattern, pos, texts = TOKENS[family], 0, []  # texts: open template texts, by the depth of the brackets around them
        while pos < len(body):
            if family == "script":
                if body[pos] == "`" or (texts and body[pos] == "}" and texts[-1] == len(self._open)):
                    if body[pos] == "}":
                        texts.pop()
                    end = _TEMPLATE.match(body, pos + 1).end()
                    self._add('""', pos)
                    if body.startswith("${", end):
                        texts.append(len(self._open))
                        end += 1
                    pos = end + 1
                    continue
                if body[pos] == "/" and body[pos + 1 : pos + 2] not in ("/", "*") and (self.text[-1] if self.text else "") in _BEFORE_REGEX and (m := _REGEX.match(body, pos)):
                    self._add(m[0], pos)
                    pos = m.end()
                    continue
            if family == "rust" and body.startswith("/*", pos):
                pos = _nested_comment(body, pos)
                continue
            m = pattern.match(body, pos)
            if m["skip"] is not None or m[0].isspace():
                self._broken |= "\n" in m[0]
            else:
                self._add('""' if m["text"] is not None else m[0], pos, m["word"] is not None)
            pos = m.end()
        for k in self._open:
            self.close[k] = len(self.text)

    def _add(self, text: str, at: int, word: bool = False) -> None:
        k = len(self.text)
        while text in _PAIRS and self._waiting[_PAIRS[text]]:  # brackets left open inside are closed with it
            o = self._open.pop()
            self._waiting[self.text[o]] -= 1
            self.close[o], self.opener[k] = k, o
            if self.text[o] == _PAIRS[text]:
                break
        self.text.append(text)
        self.at.append(at)
        self.line.append(self._broken or not k)
        self.inside.append(self._open[-1] if self._open else -1)
        self._broken = False
        if word:
            self.words.add(k)
        if text in self._waiting:
            self._waiting[text] += 1
            self._open.append(k)

    def __len__(self) -> int:
        return len(self.text)

    def get(self, k: int) -> str:
        return self.text[k] if 0 <= k < len(self.text) else ""

    def named(self, k: int) -> str | None:
        return self.text[k] if k in self.words else None

    def past(self, k: int) -> int:
        """The token after a bracket's partner, or after ``k`` itself."""
        return self.close.get(k, k) + 1

    def past_types(self, k: int) -> int:
        """The token after a list of type parameters, if one starts at ``k``."""
        if self.get(k) != "<":
            return k
        depth = 0
        while k < len(self):
            depth += {"<": 1, ">": -1}.get(self.text[k], 0)
            k = self.past(k)
            if depth == 0:
                return k
        return k


def _nested_comment(body: str, pos: int) -> int:
    depth = 0
    for m in _COMMENT_ENDS.finditer(body, pos):
        depth += 1 if m[0] == "/*" else -1
        if depth == 0:
            return m.end()
    return len(body)


def _ends_before(s: Source, k: int) -> bool:
    """Whether a statement may start at token ``k``."""
    before = s.get(k - 1)
    return k == 0 or s.inside[k] == k - 1 and before == "{" or before in (";", "}") or s.line[k] and before not in _GOES_ON


def _body_of(s: Source, k: int) -> int | None:
    """The brace that begins a function's body, ``k`` being the token after its parameters; None if it has none."""
    if s.get(k) == "{":
        return k
    if s.get(k) != ":":
        return None
    k += 1
    while k < len(s):
        text, before = s.text[k], s.get(k - 1)
        if text in (";", ",", "}", ")", "]", "=") or s.line[k] and before not in _GOES_ON and text not in ("|", "&", "=>", "{", "."):
            return None
        if text == "{" and before not in (":", "|", "&", "<", "=>", "is", "("):
            return k
        k = s.past(k)
    return None


def _is_arrow(s: Source, k: int) -> bool:
    """Whether a function without a name of its own starts at ``k``."""
    k += s.get(k) == "async"
    if s.get(k) == "function":
        return s.get(k + 1) != "*"
    k = s.past_types(k)
    if s.get(k) != "(":
        return k in s.words and s.get(k + 1) == "=>"
    k = s.past(k)
    if s.get(k) == ":":
        k += 1
        while k < len(s) and s.text[k] not in ("=>", ";", ",", ")", "="):
            k = s.past(k)
    return s.get(k) == "=>"


def _script(s: Source) -> Iterator[Construct]:
    classes, objects = set(), set()
    for k, text in enumerate(s.text):
        if text == "class" and s.get(k - 1) != "." and s.get(k + 1) != ":":
            b = k + 1
            while b < len(s) and s.text[b] not in ("{", ";", ")", "}"):
                b = s.past_types(b) if s.text[b] == "<" else s.past(b)
            classes.add(b)
        elif text == "{" and s.get(k - 1) in ("=", "(", ",", ":", "[", "?", "return", "&", "|", "..."):
            objects.add(k)
    for k, text in enumerate(s.text):
        around = s.inside[k]
        if around in classes or around in objects:
            before = s.get(k - 1)
            if before in ("{", ";", "}", ",") or around in classes and (s.line[k] and before not in _GOES_ON or _after_decorator(s, k, around)):
                found = _member(s, k)
                if found:
                    yield found
            continue
        if k not in s.words and text != "@":
            continue
        start, first = k, k
        if text == "@" and _decorated(s, k):
            continue
        if not (_ends_before(s, k) or s.get(k - 1) in ("export", "default", "declare")):
            continue
        while s.get(k) == "@":  # decorators belong to the class, or the export, that follows
            k = s.past_types(k + 2)
            while s.get(k) == ".":
                k += 2
            k = s.past(k) if s.get(k) == "(" else k
        text = s.get(k)
        if first != k and text not in ("class", "export"):
            continue
        if first == k and text in ("class", "export") and _decorated(s, k):
            continue  # told at its first decorator
        pos, after = s.at[start], s.get(k + 1)
        if text == "export" and after not in (":", "=", "(", "."):
            yield Construct(pos, "export", None)
        elif text == "import" and after not in ("(", ".", ":", "="):
            yield Construct(pos, "import", None)
        elif text == "class" and k + 1 in s.words:
            yield Construct(pos, "class", s.named(k + 1))
        elif text in ("function", "async") and s.get(k + (text == "async")) == "function":
            name = k + 1 + (text == "async")
            params = s.past_types(name + 1)
            if name in s.words and s.get(params) == "(" and _body_of(s, s.past(params)) is not None:
                yield Construct(pos, "func", s.named(name))
        elif text == "interface" and k + 1 in s.words and s.get(k + 2) in ("{", "<", "extends"):
            yield Construct(pos, "iface", after)
        elif text == "type" and k + 1 in s.words and s.get(k + 2) in ("=", "<"):
            yield Construct(pos, "type", after)
        elif text == "enum" and k + 1 in s.words and s.get(k + 2) == "{" and s.get(k - 1) != "const":
            yield Construct(pos, "enum", after)
        elif text == "const" and after == "enum":
            yield Construct(pos, "enum", s.named(k + 2))
        elif text in ("const", "let"):
            name = _function_value(s, k)
            if name:
                yield Construct(pos, "func", name)


def _function_value(s: Source, k: int) -> str | None:
    """The first of the names that a declaration at ``k`` gives to a function."""
    k, name, typed = k + 1, s.named(k + 1), False
    while k < len(s) and s.text[k] != ";" and not (s.line[k] and s.get(k - 1) not in _GOES_ON and s.text[k] not in ("=", ",", ".", "?", ":", "|", "&", "=>", "+", "-", "*", "(", "[", "{")):
        if s.text[k] in (")", "]", "}"):
            return None
        if s.text[k] == ":":
            typed = True
        if s.text[k] == "=" and s.get(k + 1) != "=":
            if _is_arrow(s, k + 1):
                return name
            typed = False
        if s.text[k] == "," and not typed:
            name = s.named(k + 1)
        k = s.past(k)
    return None


def _decorated(s: Source, k: int) -> bool:
    """Whether decorators stand right before ``k``; the construct was told at the first of them."""
    j = k - 1
    if s.get(j) == ")":
        j = s.opener.get(j, 0) - 1
    while j > 1 and s.get(j - 1) == ".":
        j -= 2
    return s.get(j - 1) == "@" and j in s.words


def _after_decorator(s: Source, k: int, around: int) -> bool:
    return s.inside[k] == around and _decorated(s, k)


def _member(s: Source, k: int) -> Construct | None:
    """The method, with a body, of a class or an object whose member starts at ``k``."""
    start = k
    while s.get(k) in _SCRIPT_MODIFIERS and s.get(k + 1) not in ("(", "=", ":", ";", "?", "<", ","):
        k += 1
    k += s.get(k) == "*"
    name = s.get(k)
    if name == "[":
        k = s.past(k)
    elif k in s.words or name == '""':
        k += 1
    else:
        return None
    k = s.past_types(k + (s.get(k) == "?"))
    if s.get(k) != "(" or _body_of(s, s.past(k)) is None:
        return None
    return Construct(s.at[start], "method", name if name not in ("[", '""') else None)


def _go(s: Source) -> Iterator[Construct]:
    for k, text in enumerate(s.text):
        if text not in ("type", "func", "import") or not _ends_before(s, k):
            continue
        if text == "type":
            yield Construct(s.at[k], "type", s.named(k + 1))
        elif s.inside[k] != -1:
            continue
        elif text == "import":
            yield Construct(s.at[k], "import", None)
        elif k + 1 in s.words:
            yield Construct(s.at[k], "func", s.named(k + 1))
        elif s.get(k + 1) == "(" and s.past(k + 1) in s.words:
            yield Construct(s.at[k], "method", s.named(s.past(k + 1)))


def _rust(s: Source) -> Iterator[Construct]:
    raw, until = set(), -1  # brackets of macros: what is in them is no code yet
    for k, text in enumerate(s.text):
        if text == "!" and k - 1 in s.words:
            b = k + 1 + (k + 1 in s.words)
            if s.get(b) in ("(", "[", "{"):
                raw.add(b)
        if k in raw:
            until = max(until, s.close[k])
        if k < until or k not in s.words or s.get(k - 1) not in ("", ";", "{", "}", "]"):
            continue
        start = k
        while s.get(k) in _RUST_MODIFIERS:
            k += 1
            if s.get(k) == "(" and s.get(k - 1) == "pub":
                k = s.past(k)
            k += s.get(k) == '""'
        kind = _RUST_KINDS.get(s.get(k))
        if kind is None or kind == "func" and k + 1 not in s.words:
            continue
        name = s.named(k + 1)
        if kind == "impl":
            end = k + 1
            while end < len(s) and s.text[end] not in ("{", ";", "where"):
                if s.text[end] == "for" or end == k + 1:
                    j = s.past_types(end + (s.text[end] == "for"))
                    while s.get(j) in ("&", "mut", "dyn"):
                        j += 1
                    while s.get(j + 1) == "::":
                        j += 2
                    name = s.named(j)
                end = s.past(end)
        elif kind == "import":
            name = None
        elif kind in ("func", "type"):
            end = k + 1
            while end < len(s) and s.text[end] not in ("{", ";", "}", "="):
                end = s.past(end)
            if kind == "func" and s.get(end) != "{" or kind == "type" and s.get(end) != "=":
                continue  # only declared, in a trait
        yield Construct(s.at[start], kind, name)


def _python(body: str) -> Iterator[Construct]:
    try:
        tree = python_ast.parse(body)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    lines = re.split(r"\r\n|\r|\n", body)
    starts = [0] + [m.end() for m in re.finditer(r"\r\n|\r|\n", body)]

    def at(line: int, column: int) -> int:  # columns are told in UTF-8 bytes
        return starts[line - 1] + len(lines[line - 1].encode()[:column].decode(errors="ignore"))

    for node in python_ast.walk(tree):
        if isinstance(node, (python_ast.ClassDef, python_ast.FunctionDef, python_ast.AsyncFunctionDef)):
            yield Construct(at(node.lineno, node.col_offset), "class" if isinstance(node, python_ast.ClassDef) else "func", node.name)
            if node.decorator_list:
                first = node.decorator_list[0]
                yield Construct(body.rindex("@", 0, at(first.lineno, first.col_offset)), "decorated", node.name)
        elif isinstance(node, python_ast.Import) or isinstance(node, python_ast.ImportFrom) and node.module != "__future__":
            yield Construct(at(node.lineno, node.col_offset), "import", None)


def family_of(path: str | None) -> str | None:
    """The family of a path's language, by its extension."""
    m = re.search(r"\.([^./\\]+)$", path or "")
    return FAMILIES.get(P.LANGUAGES.get(m[1].lower(), "")) if m else None


def constructs(body: str | None, path: str | None) -> list[Construct]:
    """A file's constructs by position; where two start at one place, the one with the higher score."""
    family = family_of(path)
    if not body or family is None:
        return []
    found = _python(body) if family == "python" else {"script": _script, "go": _go, "rust": _rust}[family](Source(body, family))
    best: dict[int, Construct] = {}
    for c in found:
        if c.pos not in best or SCORES[c.kind] > SCORES[best[c.pos].kind]:
            best[c.pos] = c
    return [best[pos] for pos in sorted(best)]


def code_points(body: str, path: str) -> list[tuple[int, int, str]]:
    """(position, score, type) of a file's constructs, as break points."""
    return [(c.pos, SCORES[c.kind], f"ast:{c.kind}") for c in constructs(body, path)]


SYMBOL_ARROW = pa.list_(pa.struct([("pos", pa.int32()), ("line", pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("score", pa.int32())]))


def symbols(files: DataFrame) -> DataFrame:
    """The constructs of files (path, body; any other columns are kept): pos, line (from 1), kind, name, score. Files without any give no row."""

    def found(bodies: list, paths: list) -> list:
        return [_rows(b, p) for b, p in zip(bodies, paths)]

    run = by_pieces("array<struct<pos:int,line:int,kind:string,name:string,score:int>>", SYMBOL_ARROW, found)
    rest = [F.col(f"`{c}`") for c in files.columns if c not in ("body", "pos", "line", "kind", "name", "score")]
    return files.select(*rest, F.explode(run("body", "path")).alias("tarn_symbol")).select(*rest, "tarn_symbol.*")


def _rows(body: str | None, path: str | None) -> list[dict]:
    found = constructs(body, path)
    ends = [m.start() for m in re.finditer("\n", body)] if found else []
    return [{"pos": c.pos, "line": bisect_right(ends, c.pos - 1) + 1, "kind": c.kind, "name": c.name, "score": SCORES[c.kind]} for c in found]
