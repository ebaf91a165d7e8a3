"""Column operators: projection, naming, casts, splitting, merging, null filling."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import scan, textfn
from ..functions.core import (OpError, as_list, col, existing, is_numeric, is_string, is_temporal, need, need_new,
                              one_of, text)
from ..functions.dates import parse_any

# words read as true and false (fixed values)
TRUE_WORDS = ("true", "yes", "1", "t", "y")
FALSE_WORDS = ("false", "no", "0", "f", "n")


def select_columns(df: DataFrame, columns, strict: bool = True) -> DataFrame:
    names = as_list(columns)
    if strict:
        need(df, names)
    return df.select(*[col(c) for c in names if c in df.columns])


def remove_columns(df: DataFrame, columns, strict: bool = True) -> DataFrame:
    names = as_list(columns)
    found = existing(df, names)
    if strict and names and not found:
        raise OpError(f"columns not found: {names}")
    return df.drop(*found)


def rename_columns(df: DataFrame, mapping: Mapping[str, str], strict: bool = True) -> DataFrame:
    if strict:
        need(df, mapping)
    used = {k: v for k, v in mapping.items() if k in df.columns}
    after = [used.get(c, c) for c in df.columns]
    if len(set(after)) != len(after):
        raise OpError("renaming would give two columns the same name")
    return df.withColumnsRenamed(used)


def reorder_columns(df: DataFrame, order, strict: bool = False) -> DataFrame:
    order = as_list(order)
    need(df, order)
    rest = [] if strict else [c for c in df.columns if c not in order]
    return df.select(*[col(c) for c in [*order, *rest]])


def add_column(df: DataFrame, name: str, value=None, from_column: str | None = None, position="end") -> DataFrame:
    need_new(df, [name])
    if from_column is not None:
        need(df, [from_column])
    new = (col(from_column) if from_column else F.lit(value)).alias(name)
    at = len(df.columns) if position == "end" else 0 if position == "start" else int(position)
    names = [col(c) for c in df.columns]
    return df.select(*names[:at], new, *names[at:])


def add_expression(df: DataFrame, expression: str, name: str = "new_column") -> DataFrame:
    """A new column from a Spark SQL expression over the frame's columns."""
    return df.withColumn(name, F.expr(expression))


def copy_column(df: DataFrame, source: str, destination: str) -> DataFrame:
    need(df, [source])
    need_new(df, [destination])
    return df.withColumn(destination, col(source))


def split_column(df: DataFrame, column: str, delimiter: str = ",", new_columns=None, keep_original: bool = False,
                 max_splits: int = -1, expand: bool = True, array_column: str | None = None) -> DataFrame:
    """Split text into named columns, numbered columns (one pass finds the width), or an array, which takes
    the column's place or the name ``array_column``."""
    need(df, [column])
    limit = max_splits + 1 if max_splits and max_splits > 0 else -1
    pieces = F.split(text(df, column), textfn.splitter(delimiter), limit)
    if not expand:
        return df.withColumn(array_column or column, pieces)
    names = as_list(new_columns)
    if not names:
        width = df.agg(F.max(F.size(pieces))).first()[0] or 0
        names = [f"{column}_{i + 1}" for i in range(max(width, 0))]
    need_new(df if keep_original else df.drop(column), names)
    out = df.withColumn("__pieces", pieces)
    keep = [col(c) for c in df.columns if keep_original or c != column]
    return out.select(*keep, *[F.get("__pieces", F.lit(i)).alias(n) for i, n in enumerate(names)])


def merge_columns(df: DataFrame, columns, new_column: str = "merged", separator: str = " ", keep_original: bool = False,
                  null_text: str = "nan") -> DataFrame:
    names = as_list(columns)
    need(df, names)
    merged = F.concat_ws(separator, *[F.coalesce(text(df, c), F.lit(null_text)) for c in names])
    keep = df.columns if keep_original else [c for c in df.columns if c not in names]
    return df.select(*[col(c) for c in keep if c != new_column], merged.alias(new_column))


def concat_columns(df: DataFrame, columns, new_column: str, separator: str = "", skip_null: bool = True,
                   null_text: str = "nan") -> DataFrame:
    names = as_list(columns)
    need(df, names)
    parts = [text(df, c) for c in names]
    if skip_null:
        value = F.when(F.coalesce(*parts).isNotNull(), F.concat_ws(separator, *parts))
    else:
        value = F.concat_ws(separator, *[F.coalesce(p, F.lit(null_text)) for p in parts])
    return df.withColumn(new_column, value)


def cast_expr(df: DataFrame, column: str, to_type: str, date_format: str | None = None) -> Column:
    """The column read as the target type; what cannot be read is null."""
    c = col(column)
    s = textfn.strip(text(df, column))
    if to_type in ("string", "str", "category"):
        return text(df, column)
    if to_type in ("integer", "int"):
        if is_numeric(df, column):
            return F.when(c == F.floor(c), c).try_cast("bigint")
        number = s.try_cast("double")
        return F.coalesce(s.try_cast("bigint"), F.when(number == F.floor(number), number).try_cast("bigint"))
    if to_type in ("float", "double"):
        return c.cast("double") if is_numeric(df, column) else s.try_cast("double")
    if to_type in ("boolean", "bool"):
        if isinstance(df.schema[column].dataType, T.BooleanType):
            return c
        w = F.lower(s if not is_numeric(df, column) else F.format_string("%.0f", c.cast("double")))
        return F.when(w.isin(*TRUE_WORDS), True).when(w.isin(*FALSE_WORDS), False)
    if to_type in ("datetime", "date"):
        return parse_any(df, column, date_format)
    raise OpError(f"unknown type {to_type!r}")


def change_column_type(df: DataFrame, column: str, to_type: str, date_format: str | None = None,
                       errors: str = "coerce") -> DataFrame:
    """coerce: unreadable cells become null. raise: fail the job on one. ignore: keep the
    column as it is if any cell is unreadable (one counting pass decides)."""
    need(df, [column])
    one_of("errors", errors, ("coerce", "raise", "ignore"))
    new = cast_expr(df, column, to_type, date_format)
    lost = col(column).isNotNull() & new.isNull()
    if errors == "ignore":
        return df if df.where(lost).limit(1).count() else df.withColumn(column, new)
    if errors == "raise":
        new = F.when(lost, F.raise_error(F.concat(F.lit(f"cannot read as {to_type}: "), col(column).cast("string")))
                     .cast(_result_type(to_type))).otherwise(new)
    return df.withColumn(column, new)


def _result_type(to_type: str) -> str:
    return {"integer": "bigint", "int": "bigint", "float": "double", "double": "double", "boolean": "boolean",
            "bool": "boolean", "datetime": "timestamp_ntz", "date": "timestamp_ntz"}.get(to_type, "string")


def convert_type(df: DataFrame, target_columns, target_type: str = "str", errors: str = "coerce") -> DataFrame:
    """Older cast over many columns; text that is no boolean word counts as true when not empty."""
    for c in existing(df, target_columns):
        if target_type in ("bool", "boolean") and is_string(df, c):
            known = cast_expr(df, c, "boolean")
            df = df.withColumn(c, F.coalesce(known, F.length(col(c)) > 0))
        else:
            df = change_column_type(df, c, target_type, None, errors)
    return df


def coalesce(df: DataFrame, columns, new_column: str = "coalesced", default=None) -> DataFrame:
    names = as_list(columns)
    need(df, names)
    kinds = {df.schema[c].dataType.simpleString() for c in names}
    parts = [col(c) if len(kinds) == 1 else text(df, c) for c in names]
    if default is not None:
        parts.append(F.lit(default))
    return df.withColumn(new_column, F.coalesce(*parts))


def replace_null(df: DataFrame, value, columns=None) -> DataFrame:
    """Fill nulls in the given or all columns the value fits."""
    if columns is not None:
        need(df, as_list(columns))
        return df.withColumns({c: F.coalesce(col(c), F.lit(value).cast(df.schema[c].dataType) if _castable(df, c, value)
                                             else F.lit(str(value))) for c in as_list(columns)})
    return df.fillna(value)


def _castable(df: DataFrame, name: str, value) -> bool:
    if isinstance(value, str):
        return is_string(df, name) or is_temporal(df, name)
    return True


def generate_uuid(df: DataFrame, new_column: str = "uuid", format: str = "uuid4", prefix: str = "") -> DataFrame:
    """Random ids; write the result before using it twice. uuid1 gives random ids too:
    a clock and network address mean nothing on many executors."""
    need_new(df, [new_column])
    one_of("format", format, ("uuid4", "uuid1", "short"))
    u = F.expr("uuid()")
    if format == "short":
        u = F.substring(F.replace(u, F.lit("-"), F.lit("")), 1, 8)
    return df.withColumn(new_column, F.concat(F.lit(prefix), u))


def _fill(df: DataFrame, columns, limit, group_by, order_by, forward: bool) -> DataFrame:
    part = as_list(group_by)
    names = as_list(columns) or [c for c in df.columns if c not in part]
    need(df, [*names, *part])
    keys = scan.need_order(df, order_by)
    names = [c for c in names if c not in {k.name for k in keys}]
    if not names:
        return df
    cells = df.columns
    if limit is None:
        out = scan.last_known(df, part, keys, {c: f"__f{i}" for i, c in enumerate(names)}, forward)
    else:
        if limit < 1:
            raise OpError("limit must be at least 1")
        out = scan.last_within(df, part, keys, {c: f"__f{i}" for i, c in enumerate(names)}, limit, forward)
    grouped = F.lit(True)
    for p in part:
        grouped = grouped & col(p).isNotNull()
    filled = {c: F.when(grouped, F.col(f"__f{i}")) for i, c in enumerate(names)}
    return out.select(*[filled[c].alias(c) if c in filled else col(c) for c in cells])


def fill_forward(df: DataFrame, columns=None, limit: int | None = None, group_by=None, order_by=None) -> DataFrame:
    """Last non-null value carried forward; rows of a null group get null."""
    return _fill(df, columns, limit, group_by, order_by, True)


def fill_backward(df: DataFrame, columns=None, limit: int | None = None, group_by=None, order_by=None) -> DataFrame:
    return _fill(df, columns, limit, group_by, order_by, False)


# a word of a header: letters, digits and joined marks, after everything else but spaces and underscores is gone
_WORD = re.compile(r"[^\s_]+")


def header_words(name: str) -> list[str]:
    return _WORD.findall("".join(c for c in name if c.isalnum() or c.isspace() or c == "_"))


def snake_words(words: Sequence[str]) -> str:
    """Lower case, joined by underscores, also where a small ASCII letter meets a capital one."""
    out = []
    for word in words:
        cuts = [i for i in range(1, len(word)) if "a" <= word[i - 1] <= "z" and "A" <= word[i] <= "Z"]
        out += [word[a:b].lower() for a, b in zip([0, *cuts], [*cuts, len(word)])]
    return "_".join(out)


def camel_words(words: Sequence[str]) -> str:
    return "".join(w.lower() if i == 0 else w.title() for i, w in enumerate(words))


def sanitize_headers(df: DataFrame, style: str = "snake_case") -> DataFrame:
    """Clean column names; no data is read."""
    one_of("style", style, ("snake_case", "camelCase"))
    join = snake_words if style == "snake_case" else camel_words
    return df.toDF(*[join(header_words(c)) for c in df.columns])
