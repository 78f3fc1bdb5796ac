"""Text functions as column expressions: titles, lines, CJK spacing, line numbers, ages and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scripts whose characters are tokens of their own (Java names).
CJK = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"
#: What a token is: letters and digits, and one character of these scripts.
TOKEN = rf"[{CJK[1:-1]}&&[\p{{L}}\p{{N}}]]|[\p{{L}}\p{{N}}&&[^{CJK[1:-1]}]]+"

#: Where no character of these scripts can be (all of theirs are in these ranges), a token is simply this.
MAYBE_CJK, PLAIN_TOKEN = r"[\x{1100}-\x{11FF}\x{2E80}-\x{10FFFF}]", r"[\p{L}\p{N}]+"

#: Words that say nothing of an intent (fixed values).
INTENT_STOP_WORDS = """
am an as at be by do he if in is it me my no of on or so to up us we
all and any are but can did for get has her him his how its let may not our out the too was who why you
also does find from have into more need show some tell that them this want what when will with your
about looking notes search where which
""".split()


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order; CJK characters stand alone."""
    found = lambda pattern: F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))
    return F.when(text.rlike(MAYBE_CJK), found(TOKEN)).otherwise(found(PLAIN_TOKEN))


def token_count(text: Column) -> Column:
    """How many tokens there are."""
    n = lambda pattern: F.regexp_count(text, F.lit(pattern))
    return F.when(text.rlike(MAYBE_CJK), n(TOKEN)).otherwise(n(PLAIN_TOKEN))


def spaced_cjk(text: Column) -> Column:
    """Han, kana and hangul characters with blanks around each."""
    return F.regexp_replace(text, f"({CJK})", " $1 ")


def contains_cjk(text: Column) -> Column:
    return text.rlike(CJK)


def title(doc: Column, path: Column) -> Column:
    """A Markdown file's first heading of one or two signs (the next second-level one after a bare "Notes"), an Org file's title or heading, else the file's stem."""
    some = lambda x: F.when(F.trim(x) != "", F.trim(x))
    heading = some(F.regexp_extract(doc, r"(?m)^##?\s+(.+)$", 1))
    second = some(F.regexp_extract(doc, r"(?m)^##\s+(.+)$", 1))
    markdown = F.when(heading.isin("Notes", "📝 Notes"), F.coalesce(second, heading)).otherwise(heading)
    org = F.coalesce(some(F.regexp_extract(doc, r"(?im)^#\+TITLE:\s*(.+)$", 1)), some(F.regexp_extract(doc, r"(?m)^\*+\s+(.+)$", 1)))
    name = F.element_at(F.split(path, "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]+$", "")
    lower = F.lower(path)
    own = F.when(lower.endswith(".md"), markdown).when(lower.endswith(".org"), org)
    return F.coalesce(own, F.when(stem != "", stem), path)


def lines(doc: Column) -> Column:
    return F.split(doc, "\n", -1)


def line_slice(doc: Column, first: int | None = None, count: int | None = None) -> Column:
    """``count`` lines from line ``first`` (from 1); both are at least 1, and null where they are not given."""
    all_ = lines(doc)
    start = max(1, first or 1)
    n = F.size(all_) if count is None else F.lit(max(1, count))
    return F.array_join(F.slice(all_, start, n), "\n")


def numbered(doc: Column, first: int = 1) -> Column:
    """Every line with its number before it."""
    return F.array_join(F.transform(lines(doc), lambda x, i: F.concat((i + first).cast("string"), F.lit(": "), x)), "\n")


def clipped(doc: Column, most: int) -> Column:
    """At most so many lines, and a note of how many more there are."""
    n = F.size(lines(doc))
    note = F.concat(F.lit("\n\n[... truncated "), (n - most).cast("string"), F.lit(" more lines]"))
    return F.when(n > most, F.concat(line_slice(doc, 1, most), note)).otherwise(doc)


def best_line(doc: Column, terms: list[str]) -> Column:
    """Number of the line (from 1) that holds most of the terms, the first of equals."""
    held = lambda x: sum((F.lower(x).contains(t).cast("int") for t in terms), F.lit(0))
    scored = F.transform(lines(doc), lambda x, i: F.struct((-held(x)).alias("s"), i.alias("i")))
    return F.array_min(scored)["i"] + 1


def highlighted(doc: Column, terms: list[str], before: str = "**", after: str = "**") -> Column:
    """Terms of three characters or more marked, whatever their case."""
    import re

    some = [re.escape(t) for t in terms if len(t) >= 3]
    return F.regexp_replace(doc, f"(?i)({'|'.join(some)})", f"{before}$1{after}") if some else doc


def intent_terms(intent: str | None) -> list[str]:
    """Words that say what a query is after: stripped of punctuation, no stop words, more than one character."""
    import regex

    stripped = (regex.sub(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "", t) for t in (intent or "").lower().split())
    return [t for t in stripped if len(t) > 1 and t not in INTENT_STOP_WORDS]


def intent_words(intent: Column) -> Column:
    """As ``intent_terms``, for a column."""
    stripped = F.transform(F.split(F.lower(F.coalesce(intent, F.lit(""))), r"(?U)\s+"), lambda x: F.regexp_replace(x, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.filter(stripped, lambda x: (F.length(x) > 1) & ~x.isin(INTENT_STOP_WORDS))


def line_range(doc: Column, first: Column, count: Column) -> Column:
    """As ``line_slice``, with a row's own first line and number of lines; null is from the start, and all there are."""
    all_ = lines(doc)
    return F.array_join(F.slice(all_, F.greatest(F.coalesce(first, F.lit(1)), F.lit(1)), F.greatest(F.coalesce(count, F.size(all_)), F.lit(1))), "\n")


def byte_length(doc: Column) -> Column:
    return F.octet_length(doc)


def days_since(then: Column, now: Column) -> Column:
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(then)) / 86400).cast("int")


def whole_days_since(then: Column, now: Column) -> Column:
    """As ``days_since``, but days are whole ones in both directions: a moment less than a day ahead is 0 days away, where the former says -1."""
    s = F.unix_timestamp(now) - F.unix_timestamp(then)
    return F.when(s < 0, -F.floor(-s / 86400)).otherwise(F.floor(s / 86400)).cast("int")


def time_ago(then: Column, now: Column) -> Column:
    """"12s ago", "5m ago", "3h ago", "2d ago"."""
    s = F.unix_timestamp(now) - F.unix_timestamp(then)
    unit = lambda size, sign: F.concat(F.floor(s / size).cast("string"), F.lit(f"{sign} ago"))
    return F.when(s < 60, unit(1, "s")).when(s < 3600, unit(60, "m")).when(s < 86400, unit(3600, "h")).otherwise(unit(86400, "d"))


def readable_bytes(n: Column) -> Column:
    """"512 B", "1.5 KB", "3.0 MB"."""
    out = F.format_string("%d B", n)
    for power, sign in enumerate(("KB", "MB", "GB"), 1):
        out = F.when(n >= 1024**power, F.format_string(f"%.1f {sign}", n / 1024**power)).otherwise(out)
    return out


def readable_ms(ms: Column) -> Column:
    """"250ms", "1.5s"."""
    return F.when(ms < 1000, F.format_string("%dms", ms.cast("long"))).otherwise(F.format_string("%.1fs", ms / 1000))


def readable_eta(s: Column) -> Column:
    """"45s", "3m 20s", "1h 5m": seconds are rounded, minutes of an hour are whole."""
    whole, rounded = lambda x: F.floor(x).cast("long"), lambda x: F.floor(x + 0.5).cast("long")
    return (
        F.when(s < 60, F.format_string("%ds", rounded(s)))
        .when(s < 3600, F.format_string("%dm %ds", whole(s / 60), rounded(s % 60)))
        .otherwise(F.format_string("%dh %dm", whole(s / 3600), whole((s % 3600) / 60)))
    )


def csv_field(x: Column) -> Column:
    """Quoted where it holds a comma, a quote or a line end; null is empty."""
    x = F.coalesce(x.cast("string"), F.lit(""))
    return F.when(x.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def xml_text(x: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        x = F.replace(x, F.lit(sign), F.lit(entity))
    return x
