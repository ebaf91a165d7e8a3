"""Grouping and reshaping operators."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import scan
from ..functions.core import OpError, as_list, col, is_numeric, need, one_of, text
from .rows import _all_not_null, _simple_agg, aggregate_columns


def aggregate(df: DataFrame, group_by, aggregations: Mapping[str, str | list[str]], reset_index: bool = True, order_by=None) -> DataFrame:
    """Group by non-null keys; several functions of a column are named ``column_function``.

    ``reset_index`` is accepted and has no effect: keys are always columns here.
    """
    by = as_list(group_by)
    several = any(not isinstance(f, str) for f in aggregations.values())
    wanted = [(c, f, f"{c}_{f}" if several else c) for c, fs in aggregations.items() for f in as_list(fs)]
    return aggregate_columns(df, by, wanted, order_by)


def group_by(df: DataFrame, by_columns=None, aggregations: Mapping[str, str] | None = None, target_columns=None, order_by=None) -> DataFrame:
    """Older group-by: without functions every column is counted."""
    by = as_list(by_columns) or as_list(target_columns)
    aggs = dict(aggregations or {c: "count" for c in df.columns if c not in by})
    return aggregate(df, by, aggs, order_by=order_by)


def pivot(df: DataFrame, index, columns: str, values, aggfunc: str = "sum", fill_value=0, pivot_values=None, order_by=None) -> DataFrame:
    """Index by column values. Without ``pivot_values`` one distinct job lists them, sorted."""
    idx, vals = as_list(index), as_list(values)
    need(df, [*idx, columns, *vals])
    one_of("aggfunc", aggfunc, ("sum", "mean", "count", "min", "max", "first", "last", "median", "std", "nunique"))
    keyed = df.where(_all_not_null([*idx, columns]))
    if pivot_values is None:
        pivot_values = [r[0] for r in keyed.select(col(columns)).distinct().orderBy(col(columns)).collect()]  # they become column names
    keys = scan.keys_of(order_by)
    if aggfunc == "median":
        # medians of the cells first, from counted values, so that a large cell is split; then each cell holds one row
        keyed, aggs = aggregate_columns(keyed, [*idx, columns], [(v, "median", v) for v in vals]), [F.first(col(v)).alias(v) for v in vals]
    else:
        aggs = [_simple_agg(keyed, v, aggfunc, keys).alias(v) for v in vals]
    out = keyed.groupBy(*[col(c) for c in idx]).pivot(columns, list(pivot_values)).agg(*aggs)
    names = {}
    for p in pivot_values:
        for v in vals:
            source = str(p) if len(vals) == 1 else f"{p}_{v}"
            names[source] = str(p) if isinstance(values, str) else f"{v}_{p}"
    out = out.withColumnsRenamed({k: v for k, v in names.items() if k != v})
    return out if fill_value is None else out.fillna(fill_value, subset=[n for n in out.columns if n not in idx])


def unpivot(df: DataFrame, id_columns=None, value_columns=None, var_name: str = "variable", value_name: str = "value") -> DataFrame:
    """Wide to long; mixed value types meet as double when all are numbers, else as text."""
    ids = as_list(id_columns)
    vals = as_list(value_columns) or [c for c in df.columns if c not in ids]
    need(df, [*ids, *vals])
    kinds = {df.schema[c].dataType.simpleString() for c in vals}
    if len(kinds) > 1:
        numeric = all(is_numeric(df, c) for c in vals)
        df = df.select(*[col(c) for c in ids], *[(col(c).cast("double") if numeric else text(df, c)).alias(c) for c in vals])
    return df.unpivot([col(c) for c in ids], [col(c) for c in vals], var_name, value_name)


def transpose_long(df: DataFrame, key: str, value_columns=None) -> DataFrame:
    """(column, key, value) rows: the transposed table at any size."""
    return unpivot(df, [key], value_columns, "column", "value")


def transpose(df: DataFrame, key: str | None = None, use_first_column_as_header: bool = False, max_columns: int | None = None, order_by=None) -> DataFrame:
    """Rows to columns. The keys become column names and so come to the driver; ``max_columns`` makes more of them an error,
    and ``transpose_long`` has no such need."""
    if use_first_column_as_header:
        key = key or df.columns[0]
    if key is None:
        keys = scan.need_order(df, order_by)
        out = scan.number(df, [], keys, "__at").withColumn("__at", F.concat(F.lit("col_"), (F.col("__at") - 1).cast("string")))
        key, df = "__at", out
    need(df, [key])
    heads = df.select(text(df, key).alias("k")).distinct()
    heads = [r[0] for r in (heads if max_columns is None else heads.limit(max_columns + 1)).collect()]
    if max_columns is not None and len(heads) > max_columns:
        raise OpError(f"more than {max_columns} rows: use transpose_long")
    heads = sorted(heads, key=lambda h: (int(h[4:]) if key == "__at" else 0, h))
    vals = [c for c in df.columns if c != key]
    long = transpose_long(df.select(text(df, key).alias(key), *[text(df, c).alias(c) for c in vals]), key, vals)
    return long.groupBy("column").pivot(key, heads).agg(F.max("value"))
