"""Text expressions built from Spark SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .core import quote_literal

# Python's str.strip() and \s also cover these control characters
WHITE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"


def strip(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, rf"^{WHITE}+", ""), rf"{WHITE}+$", "")


def title(c: Column) -> Column:
    """Capital after every non-letter, lower case elsewhere."""
    parts = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(p.substr(F.lit(2), F.length(p))))), "")


def sentence(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(c.substr(F.lit(2), F.length(c))))


def splitter(delimiter: str) -> str:
    """One character is literal, anything longer is a pattern."""
    return quote_literal(delimiter) if len(delimiter) == 1 else delimiter


def py_slice(c: Column, start: int | None, end: int | None) -> Column:
    """Python slice of text: negative places count from the end."""
    n = F.length(c)
    lo = F.lit(0) if start is None else (F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0)))
    hi = n if end is None else (F.least(F.lit(end), n) if end >= 0 else n + end)
    return F.when(hi > lo, c.substr(lo + 1, hi - lo)).when(c.isNotNull(), F.lit(""))


def phone_digits(c: Column, keep_last_ten: bool) -> Column:
    """Ten national digits, or null."""
    d = F.regexp_replace(c, r"\D", "")
    cut = F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10))
    if keep_last_ten:
        cut = cut.when(F.length(d) > 10, F.right(d, F.lit(10)))
    return F.when(c.isNotNull(), cut.otherwise(d))


def phone_layout(digits: Column, layout: str) -> Column:
    """Fill ``###`` style layout text: each of the three ``{}`` takes a digit group."""
    head, mid, end, tail = layout.split("{}")
    return F.concat(F.lit(head), F.substring(digits, 1, 3), F.lit(mid), F.substring(digits, 4, 3), F.lit(end),
                    F.substring(digits, 7, 4), F.lit(tail))
