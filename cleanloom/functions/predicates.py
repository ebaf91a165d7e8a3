"""Row conditions as boolean columns that are never null.

A comparison with null is false, except ``ne`` and ``not_in``, which are true.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .core import OpError, col, is_string, need, num
from .dates import parse_any

OPERATORS = ("eq", "ne", "gt", "lt", "gte", "lte", "isnull", "notnull", "contains", "startswith",
             "endswith", "regex", "in", "not_in", "is_numeric", "is_date")


def _sure(c: Column, otherwise: bool = False) -> Column:
    return F.coalesce(c, F.lit(otherwise))


def condition(df: DataFrame, cond: Mapping, numeric_compare: bool = False) -> Column:
    """One ``{column, operator, value, case_sensitive}`` condition.

    ``numeric_compare`` reads the column as a number for gt/lt/gte/lte, as the
    CASE operators do.
    """
    try:
        name, op = cond["column"], str(cond.get("operator", cond.get("op", "eq")))
    except (KeyError, TypeError, AttributeError):
        raise OpError(f"bad condition: {cond!r}") from None
    if op not in OPERATORS:
        raise OpError(f"unknown operator {op!r}")
    need(df, [name])
    value, exact = cond.get("value"), bool(cond.get("case_sensitive", False))
    c, texty = col(name), is_string(df, name)
    low = texty and not exact
    if op == "isnull":
        return c.isNull()
    if op == "notnull":
        return c.isNotNull()
    if op == "is_numeric":
        return num(df, name).isNotNull()
    if op == "is_date":
        return parse_any(df, name).isNotNull() if texty else c.isNotNull()
    if op in ("contains", "regex"):
        pattern = str(value) if op == "contains" else f"^(?:{value})"
        s = c if texty else c.cast("string")
        return _sure(s.rlike(pattern if exact else f"(?i){pattern}"))
    if op in ("gt", "lt", "gte", "lte") and numeric_compare:
        left, right = num(df, name), F.lit(float(value))
    else:
        lower = (lambda v: v.lower() if isinstance(v, str) else v) if low else (lambda v: v)
        left = F.lower(c) if low else c
        if op in ("in", "not_in"):
            items = [lower(v) for v in (value if isinstance(value, (list, tuple, set)) else [value])]
            hit = _sure(left.isin([v for v in items if v is not None]))
            if None in items:
                hit = hit | c.isNull()
            return ~hit if op == "not_in" else hit
        right = F.lit(lower(value))
    if op == "startswith":
        return _sure(left.cast("string").startswith(right))
    if op == "endswith":
        return _sure(left.cast("string").endswith(right))
    if op == "ne":
        return _sure(left != right, True)
    test = {"eq": left == right, "gt": left > right, "lt": left < right, "gte": left >= right, "lte": left <= right}[op]
    return _sure(test)


def combine(df: DataFrame, conditions: Sequence[Mapping], logic: str = "and") -> Column:
    if not conditions:
        raise OpError("at least one condition is required")
    if logic not in ("and", "or"):
        raise OpError("logic must be 'and' or 'or'")
    out = condition(df, conditions[0])
    for c in conditions[1:]:
        out = out & condition(df, c) if logic == "and" else out | condition(df, c)
    return out
