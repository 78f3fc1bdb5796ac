"""Paths, document ids and globs.

A virtual path is ``tarn://collection/path``. Column functions take and give
columns; the others are for the few values that the driver handles.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME = "tarn://"

#: Folders that a scan never enters (fixed values).
EXCLUDED = ("node_modules", ".git", ".cache", "vendor", "dist", "build")


# document ids


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def docid(hash_: Column) -> Column:
    """A document's short id: the first six digits of its hash."""
    return F.substring(hash_, 1, 6)


def normalized_docid(x: Column) -> Column:
    """Without surrounding quotes and a leading #."""
    x = F.trim(x)
    x = F.when(x.rlike("""^(".*"|'.*')$""") & (F.length(x) > 1), x.substr(F.lit(2), F.length(x) - 2)).otherwise(x)
    return F.regexp_replace(x, "^#", "")


def is_docid(x: Column) -> Column:
    return normalized_docid(x).rlike("^[A-Fa-f0-9]{6,}$")


def parse_docid(x: str) -> str | None:
    """The digits of a document id, or None where ``x`` is none."""
    x = x.strip()
    if len(x) > 1 and x[0] == x[-1] and x[0] in "\"'":
        x = x[1:-1]
    x = x.removeprefix("#")
    return x if re.fullmatch("[A-Fa-f0-9]{6,}", x) else None


# virtual paths


def virtual_path(collection: Column, path: Column) -> Column:
    return F.concat(F.lit(SCHEME), collection, F.lit("/"), path)


def parse_virtual_path(x: str) -> tuple[str, str] | None:
    """(collection, path) of a virtual path in any of its spellings: more slashes, none, or an index name after it."""
    m = re.fullmatch(r"(?:tarn:)?//+([^/?]+)/?([^?]*)(?:\?.*)?", x.strip()) or re.fullmatch(r"tarn:/*([^/?]+)/?([^?]*)(?:\?.*)?", x.strip())
    return (m[1], m[2]) if m else None


def virtual_parts(x: Column) -> Column:
    """As ``parse_virtual_path``, for a column: struct(collection, path), null for what is no virtual path."""
    rule = r"^\s*(?:(?:tarn:)?//+|tarn:/*)([^/?\s][^/?]*)/?([^?]*?)(?:\?.*)?\s*$"
    return F.when(x.rlike(rule), F.struct(F.regexp_extract(x, rule, 1).alias("collection"), F.regexp_extract(x, rule, 2).alias("path")))


def encoded_path(path: Column) -> Column:
    """Percent-encoded, segment by segment, but for letters, digits and ``-_.!~*'()``."""
    def part(x: Column) -> Column:
        x = F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))
        for sign in "!'()~":  # a form's encoding has these too
            x = F.replace(x, F.lit(f"%{ord(sign):X}"), F.lit(sign))
        return x

    return F.array_join(F.transform(F.split(path, "/"), part), "/")


def slashes(path: Column) -> Column:
    """Backslashes turned to slashes."""
    return F.replace(path, F.lit("\\"), F.lit("/"))


def is_absolute(path: Column) -> Column:
    return path.rlike(r"^(/|[A-Za-z]:[\\/]|~)")


def relative_to(path: Column, root: Column) -> Column:
    """The path below ``root``; null where it is not below it."""
    p, r = slashes(path), F.regexp_replace(slashes(root), "/+$", "")
    return F.when(p == r, F.lit("")).when(p.startswith(F.concat(r, F.lit("/"))), p.substr(F.length(r) + 2, F.length(p)))


def inside(path: str, root: str) -> bool:
    """Whether a path, with . and .. resolved, is ``root`` or below it."""
    import posixpath

    a, b = (posixpath.normpath(x.replace("\\", "/")) for x in (path, root))
    return a == b or a.startswith(b.rstrip("/") + "/")


def comparable(path: Column) -> Column:
    """For comparing results with expectations: lower case, no scheme and collection, no slashes at the ends."""
    bare = F.when(path.startswith(SCHEME), F.regexp_replace(path, "^tarn://([^/]*/)?", "")).otherwise(path)
    return F.regexp_replace(F.lower(bare), "^/+|/+$", "")


def same_file(a: Column, b: Column) -> Column:
    """Equal when comparable, or one the other's end."""
    x, y = comparable(a), comparable(b)
    return (x == y) | x.endswith(y) | y.endswith(x)


def valid_collection_name(x: Column) -> Column:
    return x.rlike("^[A-Za-z0-9_-]+$")


#: Programming languages by extension (fixed values).
LANGUAGES = {"ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "jsx": "tsx", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "go": "go", "rs": "rust"}


def language_of(path: Column) -> Column:
    """Programming language by extension, null for others."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    return F.element_at(F.create_map(*pairs), ext)


def slug(path: Column) -> Column:
    """A token-friendly path: triple underscores are folders, emoji their code points, other signs dashes; the extension stays."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def dashed(paths):
        return paths.map(lambda p: None if p is None else slug_of(p))

    return dashed(path)


def slug_of(path: str) -> str | None:
    """``slug`` of one path; None where nothing of it would remain."""
    import unicodedata

    def pictures(segment: str) -> str:
        out, held = [], []
        for c in [*segment, ""]:
            if c and unicodedata.category(c) in ("So", "Sk"):
                held.append(f"{ord(c):x}")
            elif c and held and unicodedata.category(c) == "Mn":
                continue
            else:
                out += ["-".join(held), c]
                held = []
        return "".join(out)

    def dashes(segment: str) -> str:
        kept = [c if c == "$" or unicodedata.category(c)[0] in "LN" else " " for c in segment]
        return "-".join("".join(kept).split())

    *folders, name = path.replace("___", "/").split("/")
    name = pictures(name)
    ext = re.search(r"\.[A-Za-z0-9]+$", name)
    stem = name[: ext.start()] if ext else name
    parts = [*(dashes(pictures(f)) for f in folders), dashes(stem) + (ext[0] if ext else "")]
    return "/".join(p for p in parts if p) or None


# globs


def split_globs(mask: str) -> list[str]:
    """The globs of a comma-separated mask; commas inside braces or brackets separate nothing."""
    found = [x.strip() for x in re.findall(r"(?:\{[^}]*\}|\[[^\]]*\]|[^,])+", mask)]
    return [x for x in found if x] or [mask]


def glob_regex(glob: str, dots: bool = False) -> str:
    """An anchored Java and Python regular expression for a glob: ``*``, ``**``, ``?``, ``[...]``, ``{a,b}``."""
    name = "" if dots else r"(?!\.)"
    out, i, depth, fresh = [], 0, 0, True
    while i < len(glob):
        c = glob[i]
        begin = fresh
        fresh = False
        if glob.startswith("**/", i) and begin:
            out.append(rf"(?:{name}[^/]+/)*")
            i, fresh = i + 3, True
            continue
        if glob.startswith("**", i):
            out.append(rf"(?:{name}[^/]+(?:/{name}[^/]+)*)?" if begin else ".*")
            i += 2
            continue
        if c == "*":
            out.append((name if begin else "") + "[^/]*")
        elif c == "?":
            out.append((name if begin else "") + "[^/]")
        elif c == "[" and "]" in glob[i + 2 :]:
            j = glob.index("]", i + 2)
            inner = glob[i + 1 : j].replace("\\", "\\\\")
            out.append("[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]")
            i = j
        elif c == "{" and "}" in glob[i:]:
            out.append("(?:")
            depth, fresh = depth + 1, begin
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
            fresh = True
        elif c == "/":
            out.append("/")
            fresh = True
        else:
            out.append(re.escape(c))
        i += 1
    return f"^{''.join(out)}$"


def matches_globs(path: Column, globs: list[str], dots: bool = False) -> Column:
    """Whether any of the globs matches."""
    found = F.lit(False)
    for g in globs:
        found = found | path.rlike(glob_regex(g, dots))
    return found


def excluded(path: Column) -> Column:
    """Below an excluded folder, or hidden in any part."""
    named = "|".join(re.escape(x) for x in EXCLUDED)
    return path.rlike(rf"(^|/)({named})/") | path.rlike(r"(^|/)\.[^/]")
