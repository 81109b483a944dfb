"""Content analysis of plain texts: projections only, no shuffle."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import FILLED_LINE, SPACE, is_blank, split_lines, strip_ws, suffix_of, words

#: Which parser takes which file suffix.
PARSERS = {
    ".pdf": "pdf",
    ".docx": "docx",
    ".doc": "docx",
    ".txt": "txt",
    ".md": "md",
    ".png": "image",
    ".jpg": "image",
    ".jpeg": "image",
    ".gif": "image",
    ".bmp": "image",
    ".tiff": "image",
}
#: Kinds of content and the substrings that hint at them.
HINTS = (
    ("Log file", ("error", "warning", "info", "debug")),
    ("Configuration file", ("config", "setting", "option")),
    ("Documentation", ("readme", "documentation", "instructions")),
    ("Notes/Todo list", ("note", "todo", "task")),
)
MIN_PRINTABLE = 0.7


def route_parser(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds ``parser`` (null if the type is unknown) and then ``error``."""
    suffix = suffix_of(F.col(path))
    table = F.create_map(*[F.lit(x) for pair in PARSERS.items() for x in pair])
    return files.withColumn("parser", F.try_element_at(table, suffix)).withColumn(
        "error", F.when(F.col("parser").isNull(), F.concat(F.lit("Unsupported file type: "), suffix))
    )


def text_profile(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds counts of characters, lines, words and paragraphs. A null text is an empty one."""
    c = F.coalesce(F.col(text), F.lit(""))
    lines = split_lines(c)
    filled = F.regexp_count(c, F.lit(FILLED_LINE))
    return docs.withColumns(
        {
            "total_chars": F.length(c),
            "total_lines": F.size(lines),
            "non_empty_lines": filled,
            "whitespace_lines": F.size(lines) - filled,
            "words": F.size(words(c)),
            "paragraphs": F.size(F.filter(F.split(c, "\n\n"), lambda x: ~is_blank(x))),
        }
    )


def line_endings(text: Column) -> Column:
    """The line ending of a raw text: the first kind of these that occurs."""
    return (
        F.when(F.contains(text, F.lit("\r\n")), "CRLF (Windows)")
        .when(F.contains(text, F.lit("\r")), "CR (Mac)")
        .when(F.contains(text, F.lit("\n")), "LF (Unix/Linux)")
        .otherwise("Unknown")
    )


def file_type_hints(text: Column) -> Column:
    """Hints at the kind of content, in fixed order."""
    return hints_in(F.lower(text))


def hints_in(low: Column) -> Column:
    """The same of a text in lower case."""
    found = [F.when(functools.reduce(operator.or_, [F.contains(low, F.lit(mark)) for mark in marks]), F.lit(name)) for name, marks in HINTS]
    return F.array_compact(F.array(*found))


def binary_flags(text: Column) -> tuple[Column, Column]:
    """``has_bom`` and ``is_binary``: a NUL, or less than seven tenths printable characters or white space."""
    other = F.length(F.regexp_replace(text, r"(?U)[ -~\s\x1c-\x1f[^\p{C}\p{Zl}\p{Zp}\p{Zs}]]+", ""))
    n = F.length(text)
    binary = F.contains(text, F.lit("\0")) | ((n > 0) & ((n - other) / n < MIN_PRINTABLE))
    return text.startswith("﻿"), binary


def html_to_text(html: Column) -> Column:
    """Text between tags, three entities decoded, blank lines single, stripped. Bodies of scripts and styles stay."""
    out = F.regexp_replace(html, r"<[^>]+>", "")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return strip_ws(F.regexp_replace(out, rf"(?U)\n{SPACE}*\n", "\n\n"))


def flatten_frontmatter(meta: Column) -> Column:
    """``map<string, array<string>>`` -> ``map<string, string>``: lists of one are scalars, others are JSON."""
    return F.transform_values(meta, lambda _, v: F.when(F.size(v) == 1, v[0]).otherwise(F.to_json(v)))
