"""Operators over several tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import scan
from ..functions.core import OpError, as_list, attach, col, need, one_of, q
from .rows import remove_duplicates

HOW = {"left": "left", "right": "right", "inner": "inner", "outer": "full"}


def join_tables(df: DataFrame, right_table: DataFrame, left_on, right_on=None, how: str = "left",
                suffixes: Sequence[str] = ("_left", "_right")) -> DataFrame:
    """Equi-join in which null keys meet null keys. Columns in both tables get suffixes;
    keys of the same name become one column. Spark picks broadcast or sort-merge by size,
    and splits skewed sort-merge partitions at run time."""
    lk, rk = as_list(left_on), as_list(right_on) or as_list(left_on)
    one_of("how", how, tuple(HOW))
    if len(lk) != len(rk):
        raise OpError("left_on and right_on need the same length")
    need(df, lk)
    need(right_table, rk)
    shared = {l for l, r in zip(lk, rk) if l == r}
    clash = (set(df.columns) & set(right_table.columns)) - shared
    right = right_table.select(*[col(c).alias(f"__r{i}") for i, c in enumerate(right_table.columns)])
    at = {c: f"__r{i}" for i, c in enumerate(right_table.columns)}
    cond = None
    for l, r in zip(lk, rk):
        c = df[q(l)].eqNullSafe(right[at[r]])
        cond = c if cond is None else cond & c
    out = df.join(right, cond, HOW[how])
    cols = []
    for c in df.columns:
        value = df[q(c)]
        if c in shared and how in ("right", "outer"):
            value = F.coalesce(df[q(c)], right[at[c]])
        cols.append(value.alias(c + suffixes[0] if c in clash else c))
    for c in right_table.columns:
        if c not in shared:
            cols.append(right[at[c]].alias(c + suffixes[1] if c in clash else c))
    return out.select(*cols)


def join(df: DataFrame, right_data: DataFrame, on=None, left_on=None, right_on=None, how: str = "left", suffix: str = "_right") -> DataFrame:
    """Older join: only the right side takes a suffix."""
    return join_tables(df, right_data, on or left_on, on or right_on, how, ("", suffix))


def union_tables(df: DataFrame, other_tables, ignore_index: bool = True, match_columns: bool = True) -> DataFrame:
    """Stack tables on their common columns, or on all columns with nulls. ``ignore_index`` has no meaning without an index."""
    others = [other_tables] if isinstance(other_tables, DataFrame) else list(other_tables)
    if match_columns:
        common = [c for c in df.columns if all(c in o.columns for o in others)]
        if not common:
            raise OpError("the tables have no common column")
        out = df.select(*[col(c) for c in common])
        for o in others:
            out = out.unionByName(o.select(*[col(c) for c in common]))
        return out
    out = df
    for o in others:
        out = out.unionByName(o, allowMissingColumns=True)
    return out


def lookup(df: DataFrame, lookup_table: DataFrame, lookup_column: str, lookup_key: str, return_columns, default_value=None,
           lookup_order=None) -> DataFrame:
    """First row per key of the lookup table, in ``lookup_order``; misses and null hits take the default."""
    names = as_list(return_columns)
    need(df, [lookup_column])
    need(lookup_table, [lookup_key, *names])
    side = lookup_table if not lookup_order else lookup_table.select(
        *dict.fromkeys([lookup_key, *names, *[k.name for k in scan.keys_of(lookup_order)]]))
    first = remove_duplicates(side, [lookup_key], "first", lookup_order)
    first = first.select(col(lookup_key).alias(lookup_column), *[F.struct(col(n).alias("v")).alias(f"__v{i}") for i, n in enumerate(names)])
    out = attach(df, first, [lookup_column])
    for i, n in enumerate(names):
        v = F.col(f"__v{i}.v")
        if default_value is not None:
            kind = lookup_table.schema[n].dataType
            v = F.coalesce(v, F.lit(default_value).try_cast(kind))
        out = out.withColumn(n, v)
    return out.drop(*[f"__v{i}" for i in range(len(names))])
