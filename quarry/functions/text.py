"""Text functions with Unicode white space, lines and words as Python has them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space: Unicode's, and the four separators U+001C to U+001F.
SPACE = r"[\s\x1c-\x1f]"
_BREAKS = r"\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}"
LINE_BREAK = rf"\r\n|[{_BREAKS}]"
#: What is in a line that is not blank, from its first sign to its end. All line breaks are white space.
FILLED_LINE = rf"(?U)[!-~[^\s\x1c-\x1f]][ -~[^{_BREAKS}]]*+"


def strip_ws(c: Column) -> Column:
    """``c`` without white space at either end."""
    return F.regexp_replace(c, rf"(?U)^{SPACE}+|(?<!{SPACE}){SPACE}+\z", "")


def is_blank(c: Column) -> Column:
    return ~c.rlike(r"(?U)[^\s\x1c-\x1f]")


def words(c: Column) -> Column:
    """Runs of other than white space; none for a blank text."""
    return F.filter(F.split(c, rf"(?U){SPACE}+"), lambda w: w != "")


def split_lines(c: Column) -> Column:
    """Lines at any line break; a break at the end adds none, and an empty text has none."""
    pieces = F.split(c, LINE_BREAK)
    n = F.size(pieces)
    return F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, n - 1)).otherwise(pieces)


def suffix_of(path: Column) -> Column:
    """Lower-case last suffix with its dot; empty for none, for names that only start with a dot, or end in one."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]+)$", 1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)
