"""Results and documents as JSON, CSV, file lists, Markdown and XML.

Each row becomes its text by column expressions, so any number of rows can be
written with ``write.text``; ``whole`` joins a page of them, with head and foot,
for the few that are shown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.text import csv_field, numbered, xml_text

#: Head, separator and foot of a page by format (fixed values).
SEARCH_PAGE = {
    "json": ("[\n", ",\n", "\n]"),
    "csv": ("docid,score,file,title,context,line,snippet\n", "\n", ""),
    "files": ("", "\n", ""),
    "md": ("", "\n", ""),
    "xml": ("", "\n\n", ""),
    "mcp": ("docid,file,title,score,context,snippet\n", "\n", ""),
}
DOCUMENT_PAGE = {
    "json": ("[\n", ",\n", "\n]"),
    "csv": ("file,title,context,skipped,body\n", "\n", ""),
    "files": ("", "\n", ""),
    "md": ("", "\n", ""),
    "xml": ('<?xml version="1.0" encoding="UTF-8"?>\n<documents>\n', "\n", "\n</documents>"),
}
#: What an empty page is.
EMPTY = {"json": "[]", "csv": SEARCH_PAGE["csv"][0].strip(), "xml": "<results></results>", "md": "", "files": "", "mcp": SEARCH_PAGE["mcp"][0].strip()}


def _content(full: bool, line_numbers: bool) -> Column:
    c = F.col("body") if full else F.col("snippet")
    c = F.coalesce(c, F.lit(""))
    return numbered(c) if line_numbers else c


def search_row(fmt: str, full: bool = False, line_numbers: bool = False) -> Column:
    """A result as text. Columns: docid, score, file, title, context, line, snippet or body."""
    c, given = _content(full, line_numbers), lambda x: (x.isNotNull()) & (x != "")
    id_, context = F.concat(F.lit("#"), F.col("docid")), F.col("context")
    fixed = lambda n: F.regexp_replace(F.format_number("score", n), ",", "")
    if fmt == "json":
        body = c.alias("body" if full else "snippet")
        return F.to_json(F.struct(id_.alias("docid"), F.round("score", 2).alias("score"), "file", "line", "title", F.when(given(context), context).alias("context"), body))
    if fmt == "csv":
        return F.concat_ws(",", id_, fixed(4), csv_field(F.col("file")), csv_field(F.col("title")), csv_field(context), F.coalesce(F.col("line").cast("string"), F.lit("")), csv_field(c))
    if fmt == "mcp":
        return F.concat_ws(",", *(csv_field(x) for x in (id_, F.col("file"), F.col("title"), F.col("score"), context, c)))
    if fmt == "files":
        quoted = F.concat(F.lit(',"'), F.replace(context, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.concat(id_, F.lit(","), fixed(2), F.lit(","), F.col("file"), F.when(given(context), quoted).otherwise(""))
    if fmt == "md":
        head = F.when(given(F.col("title")), F.col("title")).otherwise(F.col("file"))
        about = F.when(given(context), F.concat(F.lit("**context:** "), context, F.lit("\n"))).otherwise("")
        return F.concat(F.lit("---\n# "), head, F.lit("\n\n**file:** `"), F.col("file"), F.lit("`\n**docid:** `"), id_, F.lit("`\n"), about, F.lit("\n"), c, F.lit("\n"))
    if fmt == "xml":
        attribute = lambda name, x: F.when(given(x), F.concat(F.lit(f' {name}="'), xml_text(x), F.lit('"'))).otherwise("")
        return F.concat(F.lit('<file docid="'), id_, F.lit('" name="'), xml_text(F.col("file")), F.lit('"'), attribute("title", F.col("title")), attribute("context", context), F.lit(">\n"), xml_text(c), F.lit("\n</file>"))
    raise ValueError(f"unknown format: {fmt}")


def percent(score: Column) -> Column:
    """A score as whole percents, a half rounded up."""
    return F.floor(score * 100 + 0.5).cast("long")


def summary_row() -> Column:
    """A result as a line of a summary: id, percents, file, title."""
    return F.concat(F.lit("#"), F.col("docid"), F.lit(" "), percent(F.col("score")).cast("string"), F.lit("% "), F.col("file"), F.lit(" - "), F.coalesce("title", F.lit("")))


def search_summary(rows: DataFrame, query: str) -> str:
    """A page of shown rows as a summary for people."""
    lines = [r[0] for r in rows.select(summary_row()).collect()]
    if not lines:
        return f'No results found for "{query}"'
    return "\n".join([f'Found {len(lines)} result{"s" if len(lines) > 1 else ""} for "{query}":\n', *lines])


def document_row(fmt: str) -> Column:
    """A document as text. Columns: file, title, context, body, skipped, skip_reason."""
    file, title, context, skipped = F.col("file"), F.col("title"), F.col("context"), F.col("skipped")
    body, reason = F.coalesce("body", F.lit("")), F.coalesce("skip_reason", F.lit(""))
    given = (context.isNotNull()) & (context != "")
    if fmt == "json":
        return F.to_json(F.struct("file", "title", F.when(given, context).alias("context"), F.when(skipped, True).alias("skipped"), F.when(skipped, reason).alias("reason"), F.when(~skipped, body).alias("body")))
    if fmt == "csv":
        return F.concat_ws(",", csv_field(file), csv_field(title), csv_field(context), skipped.cast("string"), csv_field(F.when(skipped, reason).otherwise(body)))
    if fmt == "files":
        quoted = F.concat(F.lit(',"'), F.replace(context, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.concat(file, F.when(given, quoted).otherwise(""), F.when(skipped, ",[SKIPPED]").otherwise(""))
    if fmt == "md":
        named = F.when(title.isNotNull() & (title != "") & (title != file), F.concat(F.lit("**Title:** "), title, F.lit("\n\n"))).otherwise("")
        about = F.when(given, F.concat(F.lit("**Context:** "), context, F.lit("\n\n"))).otherwise("")
        return F.concat(F.lit("## "), file, F.lit("\n\n"), named, about, F.when(skipped, F.concat(F.lit("> "), reason, F.lit("\n"))).otherwise(F.concat(F.lit("```\n"), body, F.lit("\n```\n"))))
    if fmt == "xml":
        tag = lambda name, x: F.concat(F.lit(f"    <{name}>"), xml_text(x), F.lit(f"</{name}>\n"))
        about = F.when(given, tag("context", context)).otherwise("")
        rest = F.when(skipped, F.concat(F.lit("    <skipped>true</skipped>\n"), tag("reason", reason))).otherwise(tag("body", body))
        return F.concat(F.lit("  <document>\n"), tag("file", file), tag("title", F.coalesce(title, F.lit(""))), about, rest, F.lit("  </document>"))
    raise ValueError(f"unknown format: {fmt}")


def whole(rows: DataFrame, row: Column, page: tuple[str, str, str], order: list | None = None, empty: str = "") -> str:
    """A page of shown rows as one text: for top-k results."""
    some = rows.orderBy(*order) if order else rows
    texts = [r[0] for r in some.select(row).collect()]
    return page[0] + page[1].join(texts) + page[2] if texts else empty


def format_search(rows: DataFrame, fmt: str, full: bool = False, line_numbers: bool = False) -> str:
    return whole(rows, search_row(fmt, full, line_numbers), SEARCH_PAGE[fmt], empty=EMPTY[fmt])


def format_documents(rows: DataFrame, fmt: str) -> str:
    page = DOCUMENT_PAGE[fmt]
    return whole(rows, document_row(fmt), page, empty=page[0].strip() + page[2].strip() if fmt == "xml" else EMPTY[fmt] if fmt == "json" else page[0].strip())
