"""Row operators: sort, filter, limit, duplicates, blanks, sampling, numbering, explode."""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import predicates, quantiles, scan, textfn
from ..functions.core import (OpError, as_list, attach, col, existing, is_numeric, is_string, need, need_new, num,
                              one_of, q, string_columns, text, tmp_name)

# Up to this many rows a sort-and-limit keeps a heap per task, and one task merges the heaps;
# above it rows are numbered in chunks instead.
HEAP_ROWS = 1_000


def _rest(df: DataFrame, used: Sequence[str]) -> list[str]:
    """Remaining sortable columns, the last tie-break."""
    plain = (T.AtomicType,)
    return [f.name for f in df.schema.fields if f.name not in used and isinstance(f.dataType, plain)]


def sort_rows(df: DataFrame, columns=None, ascending=True, na_position: str = "last", order_by=None) -> DataFrame:
    """Global sort. Ties go by ``order_by``, then by the other columns, which also
    lets the range partitioner split a value shared by very many rows."""
    columns = as_list(columns)
    if not columns:
        return df
    need(df, columns)
    one_of("na_position", na_position, ("first", "last"))
    flags = list(ascending) if isinstance(ascending, (list, tuple)) else [ascending] * len(columns)
    if len(flags) != len(columns):
        raise OpError("ascending needs one flag per column")
    keys = [scan.Key(c, bool(a), na_position == "first") for c, a in zip(columns, flags)]
    ties = scan.keys_of(order_by)
    rest = _rest(df, columns + [k.name for k in ties])
    return df.orderBy(*[k.column() for k in [*keys, *ties]], *[col(c) for c in rest])


def filter_rows(df: DataFrame, conditions, logic: str = "and", keep: bool = True) -> DataFrame:
    mask = predicates.combine(df, conditions, logic)
    return df.where(mask if keep else ~mask)


def drop_rows(df: DataFrame, target_columns=None, conditions=None, logic: str = "and") -> DataFrame:
    """Drop matching rows; without conditions drop null or blank targets, or rows with any null."""
    if conditions:
        return df.where(~predicates.combine(df, conditions, logic))
    targets = existing(df, target_columns)
    if not targets:
        return df.dropna()
    for c in targets:
        ok = col(c).isNotNull()
        if is_string(df, c):
            ok = ok & (F.coalesce(textfn.strip(col(c)), F.lit("")) != "")
        df = df.where(ok)
    return df


def _take(df: DataFrame, n: int, order_by, from_end: bool) -> DataFrame:
    keys = scan.need_order(df, order_by)
    if n < 0:
        raise OpError("row count must not be negative")
    if n <= HEAP_ROWS:
        if not from_end:
            return df.orderBy(*[k.column() for k in keys]).limit(n)
        return df.orderBy(*[k.flipped().column() for k in keys]).limit(n).orderBy(*[k.column() for k in keys])
    rn = tmp_name(df, "row")
    out = scan.number(df, [], [k.flipped() for k in keys] if from_end else keys, rn)
    return out.where(col(rn) <= n).drop(rn).orderBy(*[k.column() for k in keys])


def limit_rows(df: DataFrame, count: int, from_end: bool = False, order_by=None) -> DataFrame:
    return _take(df, count, order_by, from_end)


def head_rows(df: DataFrame, n: int = 10, order_by=None) -> DataFrame:
    return _take(df, n, order_by, False)


def tail_rows(df: DataFrame, n: int = 10, order_by=None) -> DataFrame:
    return _take(df, n, order_by, True)


def slice_rows(df: DataFrame, n: int = 10, position: str = "head", order_by=None) -> DataFrame:
    one_of("position", position, ("head", "tail"))
    return _take(df, n, order_by, position == "tail")


def offset_rows(df: DataFrame, offset: int, order_by=None) -> DataFrame:
    """Skip the first rows. Rows are numbered in chunks: a SQL OFFSET would pass them all through one task."""
    if offset < 0:
        raise OpError("offset must not be negative")
    rn = tmp_name(df, "row")
    return scan.number(df, [], scan.need_order(df, order_by), rn).where(col(rn) > offset).drop(rn)


def _ascending(keys: Sequence[scan.Key]) -> bool:
    return all(k.asc for k in keys)


def remove_duplicates(df: DataFrame, subset=None, keep="first", order_by=None) -> DataFrame:
    """Keep the first, last or no row of each group of equal ``subset`` values; null equals null.

    An aggregate, not a window: copies are combined before the shuffle, so a
    group with a third of all rows costs one row per task.
    """
    subset = as_list(subset) or list(df.columns)
    need(df, subset)
    keep = "none" if keep in (False, None) else keep
    one_of("keep", keep, ("first", "last", "none"))
    others = [c for c in df.columns if c not in subset]
    if not others and keep != "none":
        return df.distinct()
    by = [col(c) for c in subset]
    if keep == "none":
        rest = F.first(F.struct(*[col(c) for c in others])) if others else F.first(F.lit(True))
        out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), rest.alias("__r")).where("__n = 1")
        return out.select(*[col(c) if c in subset else F.col("__r")[c].alias(c) for c in df.columns])
    keys = scan.keys_of(order_by)
    need(df, [k.name for k in keys])
    sort = [scan._sort_value(df, k) for k in keys]
    if not scan._packable(scan.Chunked(df, [], keys, "", 1, 0)):
        rn = tmp_name(df, "row")
        ranked = scan.number(df, subset, keys if keep == "first" else [k.flipped() for k in keys], rn)
        return ranked.where(col(rn) == 1).drop(rn)
    ties = [col(c) for c in _rest(df, [k.name for k in keys] + subset)]
    if not sort and not ties:
        return df.dropDuplicates(subset)
    row = F.struct(*[s.alias(f"s{i}") for i, s in enumerate(sort)], *[t.alias(f"t{i}") for i, t in enumerate(ties)])
    pick = F.min_by if keep == "first" else F.max_by
    out = df.groupBy(*by).agg(pick(F.struct(*[col(c) for c in others]), row).alias("__r"))
    return out.select(*[col(c) if c in subset else F.col("__r")[c].alias(c) for c in df.columns])


def _ordered_text(df: DataFrame, by: Sequence[str], column: str, keys: Sequence[scan.Key]) -> DataFrame:
    """``', '``-joined text per group in row order, joined chunk by chunk."""
    c = scan.chunked(df.where(col(column).isNotNull()), list(by), list(keys))
    item = F.struct(*[scan._sort_value(c.df, k).alias(f"s{i}") for i, k in enumerate(c.keys)], text(df, column).alias("v"))

    def joined(items: Column) -> Column:
        return F.array_join(F.transform(F.sort_array(items), lambda x: x["v"]), ", ")

    part = c.df.groupBy(*[col(b) for b in by], col(c.chunk)).agg(joined(F.collect_list(item)).alias("v"))
    pieces = F.collect_list(F.struct(col(c.chunk).alias("c"), F.col("v")))
    return part.groupBy(*[col(b) for b in by]).agg(joined(pieces).alias(column))


def concat_parts(df: DataFrame, group_by, column: str, order_by=None, part_bytes: int = 1 << 20, separator: str = ", ") -> DataFrame:
    """The ordered text of each group in parts of bounded size: (keys, part from 0, text), to be read part by part.

    Null values are left out and groups with null keys too. A part begins with each ``part_bytes`` of the group's text, so it is at
    most one value longer; a group of any size makes small cells. ``aggregate`` with ``concat`` joins the parts to one cell.
    """
    by = as_list(group_by)
    need(df, [*by, column])
    keys = scan.need_order(df, order_by)
    known = df.where(_all_not_null([*by, column]))
    size, part = tmp_name(df, "size"), "part"
    run = scan.running(known, by, keys, {size: ("sum", F.octet_length(text(known, column)).cast("long") + len(separator.encode()))})
    before = col(size) - F.octet_length(text(known, column)) - len(separator.encode())
    item = F.struct(col(size).alias("at"), *[scan._sort_value(run, k).alias(f"s{i}") for i, k in enumerate(keys)], text(run, column).alias("v"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["v"]), separator)
    return run.withColumn(part, F.floor(before / part_bytes)).groupBy(*[col(b) for b in by], col(part)).agg(joined.alias("text"))


def value_functions(keyed: DataFrame, by: Sequence[str], wanted: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Medians, quantiles, modes and unique counts of any columns from one counted frame, which is written: the input is read once.

    The frame counts (group, column, value); modes and unique counts are small aggregates of it, and all quantiles of all columns
    are one selection on it.
    """
    columns = list(dict.fromkeys(c for c, _, _ in wanted))
    keys = [f"__k{i}" for i in range(len(by))]
    number = lambda c: num(keyed, c) if is_numeric(keyed, c) or is_string(keyed, c) else F.lit(None).cast("double")
    cells = F.array(*[F.struct(F.lit(i).alias("__c"), text(keyed, c).alias("__v"), number(c).alias("__x")) for i, c in enumerate(columns)])
    long = keyed.select(*[col(b).alias(k) for b, k in zip(by, keys)], F.inline(cells))
    counts = scan.written(long.groupBy(*keys, "__c", "__v").agg(F.max("__x").alias("__x"), F.count(F.lit(1)).alias("__n")))
    found: list[Column] = []
    sides = [counts.select(*keys).distinct()] if keys else []
    place = {c: i for i, c in enumerate(columns)}
    short = [(c, f, n) for c, f, n in wanted if f in ("mode", "nunique")]
    if short:
        numeric = [i for i, c in enumerate(columns) if is_numeric(keyed, c)]
        order = F.struct((-F.col("__n")).alias("n"), F.when(F.col("__c").isin(numeric), F.col("__x")).alias("x"), F.col("__v"))
        cut = counts.where("__v IS NOT NULL").groupBy(*keys, "__c").agg(F.min_by("__v", order).alias("__mode"), F.count(F.lit(1)).alias("__unique"))
        sides.append(cut)
        for c, f, n in short:
            mine = F.max(F.when(F.col("__c") == place[c], F.col("__mode" if f == "mode" else "__unique")))
            found.append((mine.cast(keyed.schema[c].dataType) if f == "mode" else F.coalesce(mine, F.lit(0)).cast("bigint")).alias(n))
    ranks = [(c, 0.5 if f == "median" else float(f.partition(":")[2] or 0.5), n) for c, f, n in wanted if f not in ("mode", "nunique")]
    if ranks:
        shares = sorted({p for _, p, _ in ranks})
        q = quantiles.quantiles(counts.where("__x IS NOT NULL"), [*keys, "__c"], "__x", shares, counts.count(), weight="__n")
        sides.append(q)
        found += [F.max(F.when(F.col("__c") == place[c], F.col(f"q{shares.index(p)}"))).alias(n) for c, p, n in ranks]
    out = sides[0]
    for side in sides[1:]:
        out = out.unionByName(side, allowMissingColumns=True)
    done = out.groupBy(*keys).agg(*found)
    return done.select(*[col(k).alias(b) for b, k in zip(by, keys)], *[col(n) for _, _, n in wanted])


def _of_values(fn: str) -> bool:
    """Functions that need the values of a group, not a state of fixed size."""
    return fn in ("median", "mode") or fn.startswith("quantile")


def aggregate_columns(df: DataFrame, by: Sequence[str], wanted: Sequence[tuple[str, str, str]], order_by=None) -> DataFrame:
    """Group by non-null keys; ``wanted`` lists (column, function, output name).

    All functions with a fixed-size state share one hash aggregate. Functions
    that need every value of a group are computed from pre-counted values (median,
    quantile, mode; several of them, and unique counts with them, from one counted frame) or chunks (concat) and joined on the keys.
    """
    by = list(by)
    need(df, by + [c for c, _, _ in wanted])
    keyed = df.where(_all_not_null(by)) if by else df
    keys = scan.keys_of(order_by)
    flat: list[Column] = []
    extra: list[tuple[str, str, str]] = []
    shared: list[tuple[str, str, str]] = []
    many = sum(_of_values(f) for _, f, _ in wanted) > 1
    for column, fn, name in wanted:
        if many and (_of_values(fn) or fn == "nunique"):
            shared.append((column, fn, name))
        elif _of_values(fn) or fn == "concat":
            extra.append((column, fn, name))
        else:
            flat.append(_simple_agg(df, column, fn, keys).alias(name))
    grouped = keyed.groupBy(*[col(b) for b in by])
    side = value_functions(keyed, by, shared) if shared else None
    if flat or side is None:
        out = grouped.agg(*flat) if flat else keyed.select(*[col(b) for b in by]).distinct()
        if side is not None and by:
            out = attach(out, side, by)
        elif side is not None:
            out = out.withColumns({n: side.select(col(n)).scalar() for _, _, n in shared})
    else:
        out = side
    for column, fn, name in extra:
        if fn == "concat":
            if not keys:
                raise OpError("concat needs order_by")
            side = _ordered_text(keyed, by, column, keys).withColumnRenamed(column, "__v")
        elif fn == "mode":
            side = quantiles.modes(keyed, by, column, "__v")
        else:
            p = 0.5 if fn == "median" else float(fn.partition(":")[2] or 0.5)
            side = quantiles.quantiles(keyed, by, column, [p]).withColumnRenamed("q0", "__v")
        out = attach(out, side, by) if by else out.withColumn("__v", side.select("__v").scalar())
        if fn == "concat":
            out = out.withColumn("__v", F.coalesce("__v", F.lit("")))
        out = out.withColumnRenamed("__v", name)
    return out.select(*[col(b) for b in by], *[col(n) for _, _, n in wanted])


def _all_not_null(columns: Sequence[str]) -> Column:
    mask = F.lit(True)
    for c in columns:
        mask = mask & col(c).isNotNull()
    return mask


def _simple_agg(df: DataFrame, column: str, fn: str, keys: Sequence[scan.Key]) -> Column:
    c = col(column)
    if fn in ("first", "last"):
        if not keys:
            raise OpError(f"{fn} needs order_by")
        at = F.when(c.isNotNull(), F.struct(*[scan._sort_value(df, k).alias(f"s{i}") for i, k in enumerate(keys)]))
        return (F.min_by if fn == "first" else F.max_by)(c, at)
    simple = {
        "sum": lambda: F.coalesce(F.sum(c), F.lit(0).cast(T.DoubleType() if not is_numeric(df, column) else df.schema[column].dataType)),
        "mean": lambda: F.avg(c), "avg": lambda: F.avg(c), "count": lambda: F.count(c), "min": lambda: F.min(c), "max": lambda: F.max(c),
        "std": lambda: F.stddev(c), "var": lambda: F.variance(c), "nunique": lambda: F.count_distinct(c),
        "prod": lambda: F.product(c), "size": lambda: F.count(F.lit(1)),
    }
    if fn not in simple:
        raise OpError(f"unknown aggregate {fn!r}")
    return simple[fn]()


def merge_duplicates(df: DataFrame, group_by, aggregations: Mapping[str, str] | None = None, default_agg: str = "first",
                     order_by=None) -> DataFrame:
    by = as_list(group_by)
    aggs = dict(aggregations or {})
    need(df, [*by, *aggs])
    wanted = [(c, aggs.get(c, default_agg), c) for c in df.columns if c not in by]
    out = aggregate_columns(df, by, wanted, order_by)
    return out.select(*[col(c) for c in [*by, *[n for _, _, n in wanted]]])


def fill_blanks(df: DataFrame, column: str, method: str = "value", value=None, order_by=None) -> DataFrame:
    """Fill nulls of one column: value, mean, median, mode, forward, backward."""
    need(df, [column])
    one_of("method", method, ("value", "mean", "median", "mode", "forward", "backward"))
    kind = df.schema[column].dataType
    if method == "value":
        if value is None:
            raise OpError("method 'value' needs a value")
        return df.withColumn(column, F.coalesce(col(column), F.lit(value).cast(kind)))
    if method in ("forward", "backward"):
        return scan.last_known(df, [], scan.need_order(df, order_by), {column: column}, method == "forward")
    value = fill_value(df, column, method)
    return df.withColumn(column, F.coalesce(col(column) if method == "mode" else num(df, column), value))


def fill_value(df: DataFrame, column: str, method: str) -> Column:
    """Mean, median or mode of a column as a scalar subquery."""
    if method == "mode":
        return quantiles.modes(df, [], column, "m").select("m").scalar()
    if method == "mean":
        return df.agg(F.avg(num(df, column)).alias("m")).scalar()
    return quantiles.quantiles(df, [], column, [0.5]).select("q0").scalar()


def fill_nulls(df: DataFrame, target_columns=None, method: str = "value", value=None, order_by=None) -> DataFrame:
    """Older fill: many columns, adds ``interpolate`` (linear by row position)."""
    targets = existing(df, target_columns) or list(df.columns)
    if method == "value" and value is None:
        raise OpError("method 'value' needs a value")
    method = {"ffill": "forward", "bfill": "backward"}.get(method, method)
    one_of("method", method, ("value", "mean", "median", "mode", "forward", "backward", "interpolate"))
    if method == "interpolate":
        for c in [c for c in targets if is_numeric(df, c)]:
            df = scan.settle(interpolate(df, c, order_by))
        return df
    if method in ("forward", "backward"):
        keys = scan.need_order(df, order_by)
        names = [c for c in targets if c not in {k.name for k in keys}]
        return scan.last_known(df, [], keys, {c: c for c in names}, method == "forward") if names else df
    source = df  # every fill value comes from the frame as given
    for c in targets:
        if method == "value":
            if _fits(df, c, value):
                df = fill_blanks(df, c, "value", value)
        elif method == "mode" or is_numeric(df, c):
            df = df.withColumn(c, F.coalesce(col(c) if method == "mode" else num(df, c), fill_value(source, c, method)))
    return df


def _fits(df: DataFrame, column: str, value) -> bool:
    if isinstance(value, bool):
        return isinstance(df.schema[column].dataType, T.BooleanType)
    if isinstance(value, (int, float)):
        return is_numeric(df, column)
    return is_string(df, column) if isinstance(value, str) else True


def interpolate(df: DataFrame, column: str, order_by=None, group_by=None) -> DataFrame:
    """Linear by row position; leading nulls stay, trailing ones take the last value."""
    need(df, [column])
    keys = scan.need_order(df, order_by)
    part = as_list(group_by)
    pos = tmp_name(df, "pos")
    known = F.when(col(column).isNotNull(), F.struct(col(pos).alias("p"), col(column).cast("double").alias("v")))
    numbered = scan.settle(scan.number(df, part, keys, pos).withColumn("__known", known))
    c = scan.chunked(numbered, part, keys)
    out = scan.fill_on(c, c.spread(), {"__known": "__prev"}, True)
    out = scan.fill_on(c, out, {"__known": "__next"}, False).drop(c.chunk)
    p, n = F.col("__prev"), F.col("__next")
    line = p["v"] + (n["v"] - p["v"]) * (col(pos) - p["p"]) / F.nullif(n["p"] - p["p"], F.lit(0))
    return out.withColumn(column, F.coalesce(col(column).cast("double"), line, F.when(p.isNotNull(), p["v"]))).drop(
        pos, "__known", "__prev", "__next")


def add_rows(df: DataFrame, rows: Sequence[Mapping], position: str = "bottom", order_column: str | None = None) -> DataFrame:
    """Append or prepend literal rows; missing cells are null, new columns widen the table.

    With ``order_column`` the place is kept in a new column (0 before, 1 after the table).
    """
    one_of("position", position, ("top", "bottom"))
    rows = [rows] if isinstance(rows, Mapping) else list(rows)
    if not rows:
        return df
    fields = {f.name: f.dataType for f in df.schema.fields}
    extra: dict[str, T.DataType] = {}
    for row in rows:
        for name, v in row.items():
            if name not in fields and (name not in extra or isinstance(extra[name], T.NullType)):
                extra[name] = T.LongType() if isinstance(v, int) and not isinstance(v, bool) else (
                    T.DoubleType() if isinstance(v, float) else T.BooleanType() if isinstance(v, bool) else T.StringType())
    kinds = {**fields, **extra}
    used = [n for n in kinds if any(n in r for r in rows)]
    parts = df.sparkSession.range(1).select(F.explode(F.array(*[
        F.struct(*[F.lit(r.get(n)).cast(kinds[n]).alias(n) for n in used]) for r in rows])).alias("r")).select("r.*")
    base = df
    if order_column:
        need_new(df, [order_column])
        base = df.withColumn(order_column, F.lit(1 if position == "top" else 0))
        parts = parts.withColumn(order_column, F.lit(0 if position == "top" else 1))
    first, second = (parts, base) if position == "top" else (base, parts)
    out = first.unionByName(second, allowMissingColumns=True)
    return out.select(*[col(c) for c in base.columns], *[col(c) for c in out.columns if c not in base.columns])


def sample_rows(df: DataFrame, n: int | None = None, fraction: float | None = None, seed: int | None = None,
                replace: bool = False, key=None) -> DataFrame:
    """n rows or a fraction. An exact sample orders by a hash of the row (or of ``key``); without a seed one is drawn."""
    if n is not None and fraction is not None:
        raise OpError("give n or fraction, not both")
    if fraction is not None:
        if not 0 < fraction <= 1:
            raise OpError("fraction must be in (0, 1]")
        return df.sample(withReplacement=replace, fraction=fraction, seed=seed)
    n = 10 if n is None else n
    if n < 0:
        raise OpError("n must not be negative")
    if replace:
        total = df.count()
        if total == 0 or n == 0:
            return df.limit(0)
        # n independent draws of a row number; only the drawn rows are joined
        rn = tmp_name(df, "row")
        draws = df.sparkSession.range(n).select(
            (F.pmod(F.xxhash64(F.col("id"), F.lit(seed or 0)), F.lit(total)) + 1).alias("__draw"))
        keys = as_list(key) or _rest(df, [])
        numbered = scan.number(df, [], keys, rn, total)
        return numbered.join(draws, col(rn) == F.col("__draw")).drop(rn, "__draw")
    cols = as_list(key) or df.columns
    mark = tmp_name(df, "mark")
    seed = random.getrandbits(62) if seed is None else seed
    tagged = df.withColumn(mark, F.xxhash64(*[col(c) for c in cols], F.lit(seed)))
    if n <= HEAP_ROWS:
        return tagged.orderBy(mark, *_rest(df, [])).limit(n).drop(mark)
    rn = tmp_name(tagged, "row")
    return scan.number(tagged, [], [mark, *_rest(df, [])], rn).where(col(rn) <= n).drop(rn, mark)


def shuffle_rows(df: DataFrame, seed: int | None = None, key=None) -> DataFrame:
    if seed is None:
        return df.orderBy(F.rand())
    cols = as_list(key) or df.columns
    return df.orderBy(F.xxhash64(*[col(c) for c in cols], F.lit(seed)))


def row_number(df: DataFrame, new_column: str = "row_num", start: int = 1, partition_by=None, order_by=None) -> DataFrame:
    part = as_list(partition_by)
    need(df, part)
    need_new(df, [new_column])
    out = scan.number(df, part, scan.need_order(df, order_by), new_column)
    return out.withColumn(new_column, col(new_column) + F.lit(start - 1))


def explode_column(df: DataFrame, column: str, delimiter: str = ",", trim: bool = True) -> DataFrame:
    """One row per delimited piece; null gives one null row."""
    need(df, [column])
    piece = F.explode_outer(F.split(text(df, column), textfn.splitter(delimiter)))
    out = df.select(*[piece.alias(column) if c == column else col(c) for c in df.columns])
    return out.withColumn(column, textfn.strip(col(column))) if trim else out


def explode(df: DataFrame, target_columns) -> DataFrame:
    """Explode array columns; null or empty gives one null row."""
    for c in existing(df, target_columns):
        if isinstance(df.schema[c].dataType, T.ArrayType):
            df = df.select(*[F.explode_outer(col(c)).alias(c) if n == c else col(n) for n in df.columns])
    return df
