"""Structure of markdown texts, by expressions over a row's own text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import SPACE, strip_ws

_HEADING = rf"(?Us)^(#{{1,6}}){SPACE}+(.+)\z"
_CODE = r"(?sU)```(\w*)\n(.*?)\n```"
#: Neighbouring lines with a bar.
_TABLE = r"(?md)^[^\n|]*+\|[^\n]*+(?:\n[^\n|]*+\|[^\n]*+)*+"


def anchor(text: Column) -> Column:
    """Link target of a heading."""
    kept = F.regexp_replace(F.lower(text), rf"(?U)[^\w\s\x1c-\x1f-]", "")
    return F.regexp_replace(F.regexp_replace(kept, rf"(?U)[-\s\x1c-\x1f]+", "-"), r"^-+|-+\z", "")


def headings(text: Column) -> Column:
    """``array<struct<level, text, anchor>>``; lines inside code fences count too."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip_ws), lambda x: x.rlike(_HEADING))

    def heading(x: Column) -> Column:
        title = strip_ws(F.regexp_extract(x, _HEADING, 2))
        return F.struct(F.length(F.regexp_extract(x, _HEADING, 1)).alias("level"), title.alias("text"), anchor(title).alias("anchor"))

    return F.transform(lines, heading)


def _pairs(text: Column, pattern: str, first: str, second: str) -> Column:
    groups = [F.regexp_extract_all(text, F.lit(pattern), i) for i in (1, 2)]
    return F.zip_with(*groups, lambda a, b: F.struct(a.alias(first), b.alias(second)))


def links(text: Column) -> Column:
    """``array<struct<text, url>>``; an image with a description is a link as well."""
    return _pairs(text, r"\[([^\]]+)\]\(([^)]+)\)", "text", "url")


def images(text: Column) -> Column:
    return _pairs(text, r"!\[([^\]]*)\]\(([^)]+)\)", "alt", "url")


def code_blocks(text: Column) -> Column:
    """``array<struct<language, code>>``; a block without a language is ``text``."""
    found = _pairs(text, _CODE, "language", "code")
    return F.transform(found, lambda b: F.struct(F.when(b["language"] == "", "text").otherwise(b["language"]).alias("language"), b["code"].alias("code")))


def tables(text: Column) -> Column:
    """``array<struct<headers, rows, column_count, row_count>>``.

    The first line holds the headers, the second is skipped. First and last cells of a line are dropped, as between
    outer bars. A table of one line is empty and has no row count.
    """

    def cells(line: Column) -> Column:
        parts = F.split(strip_ws(line), r"\|")
        return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), strip_ws)

    def table(block: Column) -> Column:
        lines = F.split(block, "\n")
        n = F.size(lines)
        none = F.array().cast("array<string>")
        headers = F.when(n < 2, none).otherwise(cells(lines[0]))
        rows = F.filter(F.transform(F.slice(lines, 3, F.greatest(n - 2, F.lit(0))), cells), lambda r: F.size(r) > 0)
        return F.struct(headers.alias("headers"), rows.alias("rows"), F.size(headers).alias("column_count"), F.when(n >= 2, F.size(rows)).alias("row_count"))

    return F.transform(F.regexp_extract_all(text, F.lit(_TABLE), 0), table)


def structure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the five arrays and their counts."""
    parts = {"headings": headings, "links": links, "images": images, "code_blocks": code_blocks, "tables": tables}
    out = docs.withColumns({name: f(F.col(text)) for name, f in parts.items()})
    return out.withColumns({f"{name[:-1]}_count": F.size(name) for name in parts})


#: Front matter: lines between a first line of three dashes and one of three dashes or dots.
_FRONT = r"(?s)\A---[ \t]*\n(.*?\n)?(?:---|\.\.\.)[ \t]*(?:\n|\z)"
#: A key with its value, and lines behind it that are set in by four spaces.
_FIELD = r"(?md)^ {0,3}([A-Za-z0-9_-]+):[ \t]*(.*(?:\n {4,}.*)*)$"
#: Markup and what of it stays in the plain text, in this order.
PLAIN = (
    (r"^ {0,3}```.*$\n?", ""),
    (r"!\[[^\]]*\]\([^)]+\)", ""),
    (r"\[([^\]]+)\]\([^)]+\)", "1"),
    (r"^ {0,3}#{1,6}[ \t]+", ""),
    (r"^ {0,3}>[ \t]?", ""),
    (r"^[ \t]*[-*+][ \t]+", ""),
    (r"\*\*([^*\n]+)\*\*", "1"),
    (r"\*([^*\n]+)\*", "1"),
    (r"`([^`\n]+)`", "1"),
)


def front_matter(text: Column) -> tuple[Column, Column]:
    """Keys (in lower case) with their lists of values, as ``map<string, array<string>>``, and the text behind them.

    Of a key that comes again the first is taken. Without front matter the map is empty.
    """
    block = F.concat(F.regexp_extract(text, _FRONT, 1), F.lit(""))
    names = F.regexp_extract_all(F.regexp_replace(block, _FIELD, "$1:"), F.lit(r"(?md)^([A-Za-z0-9_-]+):$"), 1)
    keys = F.when(F.size(names) > 0, F.split(F.lower(F.array_join(names, ":")), ":")).otherwise(names)
    fields = F.arrays_zip(keys.alias("k"), F.regexp_extract_all(block, F.lit(_FIELD), 2).alias("v"))
    first = F.filter(fields, lambda f, i: F.array_position(keys, f["k"]) == i + 1)
    return F.map_from_entries(F.transform(first, lambda f: F.struct(f["k"], F.split(f["v"], r"\n {4,}")))), F.regexp_replace(text, _FRONT, "")


def plain(text: Column) -> Column:
    """The text without its markup: what is indexed of it. Addresses of links and images go, code stays."""
    for pattern, group in PLAIN:
        text = F.regexp_replace(text, "(?md)" + pattern, f"${group}" if group else "")
    return text
