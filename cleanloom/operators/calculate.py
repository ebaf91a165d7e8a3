"""Numeric, conditional, ranking and window operators."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import predicates, quantiles, scan
from ..functions.core import OpError, as_list, attach, col, existing, is_numeric, need, need_new, num, one_of


def math_operation(df: DataFrame, new_column: str, operation: str, column1: str, column2: str | None = None,
                   value: float | None = None) -> DataFrame:
    """Arithmetic of a column with a column or a constant; division by a zero cell is null."""
    one_of("operation", operation, ("add", "subtract", "multiply", "divide"))
    need(df, [column1] + ([column2] if column2 else []))
    if column2 is None and value is None:
        raise OpError("give column2 or value")
    if operation == "divide" and column2 is None and value == 0:
        raise OpError("cannot divide by zero")
    a = num(df, column1)
    b = num(df, column2) if column2 else F.lit(float(value))
    out = {"add": lambda: a + b, "subtract": lambda: a - b, "multiply": lambda: a * b,
           "divide": lambda: F.try_divide(a, b)}[operation]()
    return df.withColumn(new_column, out)


def _scaled(c: Column, digits: int, fn) -> Column:
    if digits == 0:
        return fn(c).cast("double")
    m = F.lit(float(10 ** abs(digits)))
    return fn(c * m).cast("double") / m if digits > 0 else fn(c / m).cast("double") * m


def round_numbers(df: DataFrame, column, decimals: int = 0, method: str = "round") -> DataFrame:
    """Half-even rounding, floor or ceiling to a number of decimals."""
    one_of("method", method, ("round", "floor", "ceil"))
    names = as_list(column)
    need(df, names)
    fn = {"round": lambda c: F.bround(c, decimals), "floor": lambda c: _scaled(c, decimals, F.floor),
          "ceil": lambda c: _scaled(c, decimals, F.ceil)}[method]
    return df.withColumns({c: fn(num(df, c)) for c in names})


def floor_ceil(df: DataFrame, column, method: str = "floor", precision: int = 0) -> DataFrame:
    one_of("method", method, ("floor", "ceil", "ceiling"))
    names = as_list(column)
    need(df, names)
    fn = F.floor if method == "floor" else F.ceil
    return df.withColumns({c: _scaled(num(df, c), precision, fn) for c in names})


def percentage(df: DataFrame, column: str, new_column: str, mode: str = "of_total",
               denominator_column: str | None = None, multiply_by_100: bool = True) -> DataFrame:
    """Share of the column total (one-row scalar subquery) or ratio to another column."""
    one_of("mode", mode, ("of_total", "of_column"))
    need(df, [column])
    factor = F.lit(100.0 if multiply_by_100 else 1.0)
    if mode == "of_total":
        total = df.agg(F.sum(num(df, column)).alias("t")).scalar()
        share = F.when(F.coalesce(total, F.lit(0.0)) == 0, F.lit(0.0)).otherwise(num(df, column) / F.nullif(total, F.lit(0.0)))
    else:
        if not denominator_column:
            raise OpError("mode of_column needs denominator_column")
        need(df, [denominator_column])
        share = F.try_divide(num(df, column), num(df, denominator_column))
    return df.withColumn(new_column, share * factor)


def percent_of_total(df: DataFrame, target_columns, partition_by=None, suffix: str = "_pct", decimal_places: int = 2) -> DataFrame:
    """Older share of total, optionally per group, rounded half-even."""
    part = as_list(partition_by)
    names = existing(df, target_columns)
    need(df, part)
    totals = [F.sum(num(df, c)).alias(f"__t{i}") for i, c in enumerate(names)]
    if part:
        out = attach(df, df.where(_known(part)).groupBy(*[col(p) for p in part]).agg(*totals), part)
        parts = {c: F.col(f"__t{i}") for i, c in enumerate(names)}
    else:
        out = df
        row = df.agg(F.struct(*totals).alias("t")).scalar()
        parts = {c: row[f"__t{i}"] for i, c in enumerate(names)}
    out = out.withColumns({f"{c}{suffix}": F.bround(F.try_divide(num(df, c), t) * 100, decimal_places) for c, t in parts.items()})
    return out.drop(*[f"__t{i}" for i in range(len(names))])


def _known(part: Sequence[str]) -> Column:
    mask = F.lit(True)
    for p in part:
        mask = mask & col(p).isNotNull()
    return mask


CUMULATIVE = ("sum", "count", "mean", "min", "max", "prod")


def cumulative(df: DataFrame, target_columns, operation: str = "sum", partition_by=None, suffix: str | None = None,
               order_by=None) -> DataFrame:
    """Running sum, count, mean, min, max or product; null rows stay null but do not stop the run."""
    one_of("operation", operation, CUMULATIVE)
    suffix = f"_cum{operation}" if suffix is None else suffix
    part = as_list(partition_by)
    need(df, part)
    keys = scan.need_order(df, order_by)
    return _running(df, {c: f"{c}{suffix}" for c in existing(df, target_columns)}, operation, part, keys)


def _wanted(df: DataFrame, column: str, operation: str, stem: str) -> dict[str, tuple[str, Column]]:
    """The running aggregates that a cumulative column is made of."""
    x = num(df, column)
    if operation == "mean":
        return {f"{stem}a": ("sum", x), f"{stem}b": ("count", x)}
    return {f"{stem}a": ("product" if operation == "prod" else operation, x)}


def _shown(df: DataFrame, column: str, operation: str, stem: str, part) -> Column:
    value = F.col(f"{stem}a") / F.nullif(F.col(f"{stem}b"), F.lit(0)) if operation == "mean" else F.col(f"{stem}a")
    return F.when(_known(part) if operation == "count" else _known(part) & num(df, column).isNotNull(), value)


def running_columns(df: DataFrame, columns: Sequence[tuple[str | None, str, str]], part, keys) -> DataFrame:
    """Any number of running columns of one order in one scan: (column, new column, operation); without a column, the row's number."""
    wanted: dict[str, tuple[str, Column]] = {}
    for i, (c, _, operation) in enumerate(columns):
        wanted |= _wanted(df, c, operation, f"__r{i}") if c is not None else {f"__r{i}a": ("count", F.lit(1))}
    if not wanted:
        return df
    out = scan.running(df, part, keys, wanted)
    new = {name: _shown(df, c, operation, f"__r{i}", part) if c is not None else F.col(f"__r{i}a") for i, (c, name, operation) in enumerate(columns)}
    return out.withColumns(new).drop(*wanted)


def _running(df: DataFrame, columns: Mapping[str, str], operation: str, part, keys) -> DataFrame:
    return running_columns(df, [(c, name, operation) for c, name in columns.items()], part, keys)


def running_total(df: DataFrame, column: str, new_column: str, group_by=None, order_by=None) -> DataFrame:
    need(df, [column])
    part = as_list(group_by)
    need(df, part)
    return _running(df, {column: new_column}, "sum", part, scan.need_order(df, order_by))


RANKS = ("dense", "min", "max", "first", "average")


def rank(df: DataFrame, column: str, new_column: str | None = None, ascending: bool = True, method: str = "dense",
         group_by=None, order_by=None) -> DataFrame:
    """Rank within the table or a group; nulls get no rank.

    Ranks are computed on the counted distinct values and joined back, so a
    value shared by a third of the rows is one row of that work.
    """
    one_of("method", method, RANKS)
    part = as_list(group_by)
    need(df, [column, *part])
    name = new_column or f"{column}_rank"
    if method == "first":
        keys = [scan.Key(column, ascending, False), *scan.need_order(df, order_by)]
        out = scan.number(df, part, keys, "__rank")
        return out.withColumn(name, F.when(_known(part) & col(column).isNotNull(), F.col("__rank"))).drop("__rank")
    out = attach(df, rank_table(df, part, column, ascending, method), [*part, column])
    return out.withColumn(name, F.when(_known(part), F.col("__rank"))).drop("__rank")


def rank_table(df: DataFrame, part: Sequence[str], column: str, ascending: bool, method: str) -> DataFrame:
    """(group, value, __rank): one row per distinct value."""
    runs = quantiles.value_runs(df, part, column, ascending)
    before, cnt = F.col("__before"), F.col("__cnt")
    value = {"dense": F.col("__dense"), "min": before + 1, "max": before + cnt,
             "average": before + (cnt + 1) / F.lit(2.0)}[method]
    return runs.select(*[col(p) for p in part], col(column), value.alias("__rank"))


def dense_rank(df: DataFrame, column: str, new_column: str | None = None, ascending: bool = True, partition_by=None) -> DataFrame:
    return rank(df, column, new_column or f"{column}_dense_rank", ascending, "dense", partition_by)


def rank_values(df: DataFrame, target_columns, method: str = "average", ascending: bool = True, partition_by=None,
                suffix: str = "_rank", order_by=None) -> DataFrame:
    one_of("method", method, RANKS)
    part = as_list(partition_by)
    need(df, part)
    source, out = df, df
    for c in existing(df, target_columns):
        if method == "first":
            out = rank(out, c, f"{c}{suffix}", ascending, method, partition_by, order_by)
        else:  # ranks come from the frame as given, so columns do not pile up on each other
            out = attach(out, rank_table(source, part, c, ascending, method), [*part, c])
            out = out.withColumn(f"{c}{suffix}", F.when(_known(part), F.col("__rank"))).drop("__rank")
    return out


def percent_rank(df: DataFrame, column: str, new_column: str | None = None, ascending: bool = True, partition_by=None,
                 sql: bool = False) -> DataFrame:
    """rank / count of non-null values; ``sql=True`` gives (rank - 1) / (count - 1)."""
    part = as_list(partition_by)
    need(df, [column, *part])
    runs = quantiles.value_runs(df, part, column, ascending)
    totals = runs.groupBy(*[col(p) for p in part]).agg(F.sum("__cnt").alias("__n"))
    runs = attach(runs, totals, part) if part else runs.withColumn("__n", totals.select("__n").scalar())
    low = F.col("__before")
    value = (F.when(F.col("__n") > 1, low / (F.col("__n") - 1)).otherwise(0.0)) if sql else (low + 1) / F.col("__n")
    out = attach(df, runs.select(*[col(p) for p in part], col(column), value.alias("__rank")), [*part, column])
    return out.withColumn(new_column or f"{column}_percent_rank", F.when(_known(part), F.col("__rank"))).drop("__rank")


def ntile(df: DataFrame, n: int, order_by, new_column: str | None = None, ascending: bool = True, partition_by=None,
          sql: bool = False, tie_break=None) -> DataFrame:
    """Bucket floor(i*n/size)+1; ``sql=True`` gives the SQL NTILE split."""
    if n < 1:
        raise OpError("n must be at least 1")
    part = as_list(partition_by)
    names = as_list(order_by)
    need(df, [*part, *names])
    keys = [scan.Key(c, ascending, False) for c in names] + scan.keys_of(tie_break)
    out = scan.number(df, part, keys, "__rn")
    i = F.col("__rn") - 1
    if part:
        out = attach(out, df.groupBy(*[col(p) for p in part]).agg(F.count(F.lit(1)).alias("__n")), part)
    else:
        out = out.withColumn("__n", df.agg(F.count(F.lit(1)).alias("c")).scalar())
    size = F.col("__n")
    if sql:
        base, big = F.floor(size / n), size % n
        cut = big * (base + 1)
        value = F.when(i < cut, F.floor(i / (base + 1))).otherwise(big + F.floor((i - cut) / F.greatest(base, F.lit(1)))) + 1
    else:
        value = F.floor(i * n / size) + 1
    return out.withColumn(new_column or "ntile", F.when(_known(part), value).cast("bigint")).drop("__rn", "__n")


def conditional_value(df: DataFrame, new_column: str, conditions: Sequence[Mapping], default=None) -> DataFrame:
    """First matching ``{column, operator, compare_value, value}`` gives the value."""
    out = None
    for c in conditions:
        op = c.get("operator")
        need(df, [c.get("column")])
        if op not in ("eq", "ne", "gt", "lt", "gte", "lte", "contains", "isnull", "notnull"):
            continue
        test = predicates.condition(
            df, {"column": c["column"], "operator": op, "value": c.get("compare_value"), "case_sensitive": True}, True)
        out = F.when(test, F.lit(c.get("value"))) if out is None else out.when(test, F.lit(c.get("value")))
    return df.withColumn(new_column, F.lit(default) if out is None else out.otherwise(F.lit(default)))


def case_when(df: DataFrame, cases: Sequence[Mapping], new_column: str, default=None) -> DataFrame:
    """First matching ``{condition: {column, operator, value}, result}``; contains ignores case."""
    out = None
    for c in cases:
        cond = c.get("condition", {})
        op = cond.get("operator", "eq")
        if op not in ("eq", "ne", "gt", "lt", "gte", "lte", "contains", "isnull", "notnull", "in"):
            raise OpError(f"unknown operator {op!r}")
        need(df, [cond.get("column")])
        test = predicates.condition(
            df, {"column": cond["column"], "operator": op, "value": cond.get("value"), "case_sensitive": op != "contains"}, True)
        out = F.when(test, F.lit(c.get("result"))) if out is None else out.when(test, F.lit(c.get("result")))
    if out is None:
        raise OpError("at least one case is required")
    return df.withColumn(new_column, out.otherwise(F.lit(default)))


def conditional_replace(df: DataFrame, conditions: Sequence[Mapping], default=None, target_column: str = "result",
                        source_column: str | None = None) -> DataFrame:
    """First matching ``{condition: SQL text, value}``; a bad condition is an error."""
    out = None
    for c in conditions:
        test = F.coalesce(F.expr(c["condition"]), F.lit(False))
        out = F.when(test, F.lit(c.get("value"))) if out is None else out.when(test, F.lit(c.get("value")))
    other = F.lit(default) if default is not None or not source_column else col(source_column)
    return df.withColumn(target_column, other if out is None else out.otherwise(other))


def _at_places(x: float, places: int) -> float:
    """x at so many decimal places; below 1 they are counted from the first digit that is not zero."""
    if x == 0 or math.isinf(x):
        return x
    exact = Decimal(repr(float(x)))
    return float(round(exact, places + max(0, -exact.adjusted() - 1)))


def _bin_labels(edges: Sequence[float], precision: int, include_lowest: bool) -> list[str]:
    """Names of right-closed bins. Places are added until edges that differ have names that differ; a closed lowest bin is
    named from one step of the last place below its edge."""
    wanted = len(set(edges))
    places = next((p for p in range(precision, 20) if len({_at_places(e, p) for e in edges}) == wanted), 19)
    shown = [_at_places(e, places) for e in edges]
    if include_lowest and math.isfinite(shown[0]):
        shown[0] = float(Decimal(repr(float(shown[0]))) - Decimal(1).scaleb(-places))
    names = [repr(float(x)) for x in shown]
    return [f"({low}, {high}]" for low, high in zip(names, names[1:])]


def _bin_column(x: Column, edges: Sequence[float], labels: Sequence, include_lowest: bool) -> Column:
    """Label of the bin a value falls in, by halving the edge list."""
    first = x >= F.lit(edges[0]) if include_lowest else x > F.lit(edges[0])

    def pick(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(labels[lo])
        mid = (lo + hi) // 2
        return F.when(x <= F.lit(edges[mid + 1]), pick(lo, mid)).otherwise(pick(mid + 1, hi))

    return F.when(first & (x <= F.lit(edges[-1])), pick(0, len(labels) - 1))


def bin_values(df: DataFrame, column: str, bins, new_column: str | None = None, labels=None, include_lowest: bool = True) -> DataFrame:
    """Equal-width bins (one min/max pass) or explicit edges; right-closed, out of range is null."""
    need(df, [column])
    x = num(df, column)
    low = high = None
    if isinstance(bins, int) or any(math.isinf(b) for b in bins):
        low, high = df.agg(F.min(x), F.max(x)).first()
    if isinstance(bins, int):
        if bins < 1:
            raise OpError("bins must be at least 1")
        if low is None:
            return df.withColumn(new_column or f"{column}_bin", F.lit(None).cast("string"))
        if low == high:
            pad = 0.001 * abs(low) if low != 0 else 0.001
            low, high = low - pad, high + pad
            edges = [low + (high - low) * i / bins for i in range(bins + 1)]
        else:
            edges = [low + (high - low) / bins * i for i in range(bins)] + [high]
            edges[0] -= (high - low) * 0.001
    else:
        edges = [low - 1 if b == -math.inf else high + 1 if b == math.inf else float(b) for b in bins]
        if any(b <= a for a, b in zip(edges, edges[1:])):
            raise OpError("bin edges must increase")
    names = list(labels) if labels else _bin_labels(edges, 3, include_lowest)
    if len(names) != len(edges) - 1:
        raise OpError("labels must be one fewer than edges")
    return df.withColumn(new_column or f"{column}_bin", _bin_column(x, edges, [str(n) for n in names], include_lowest))


def bin_numeric(df: DataFrame, target_columns, method: str = "quantile", bins: int = 4, labels=None, suffix: str = "_bin") -> DataFrame:
    """Older binning: quantile edges (equal ones merged) or equal width without ``include_lowest``."""
    one_of("method", method, ("quantile", "equal_width", "custom"))
    for c in existing(df, target_columns):
        if method != "quantile":
            df = bin_values(df, c, bins, f"{c}{suffix}", labels, include_lowest=False)
            continue
        row = quantiles.quantiles(df, [], c, [i / bins for i in range(bins + 1)]).first()
        edges = sorted({row[f"q{i}"] for i in range(bins + 1) if row and row[f"q{i}"] is not None})
        if len(edges) < 2:
            df = df.withColumn(f"{c}{suffix}", F.lit(None).cast("string"))
            continue
        names = list(labels) if labels and len(labels) == len(edges) - 1 else _bin_labels(edges, 3, True)
        df = df.withColumn(f"{c}{suffix}", _bin_column(num(df, c), edges, [str(n) for n in names], True))
    return df


def absolute_value(df: DataFrame, column, new_column: str | None = None) -> DataFrame:
    names = as_list(column)
    need(df, names)
    return df.withColumns({(new_column if new_column and len(names) == 1 else c): F.abs(
        col(c) if is_numeric(df, c) else num(df, c)) for c in names})


def is_between(df: DataFrame, column: str, min_value, max_value, new_column: str | None = None, inclusive: str = "both") -> DataFrame:
    need(df, [column])
    one_of("inclusive", inclusive, ("both", "neither", "left", "right"))
    c = col(column)
    low = c >= F.lit(min_value) if inclusive in ("both", "left") else c > F.lit(min_value)
    high = c <= F.lit(max_value) if inclusive in ("both", "right") else c < F.lit(max_value)
    return df.withColumn(new_column or f"{column}_between", F.coalesce(low & high, F.lit(False)))


def _shift(df: DataFrame, column: str, name: str, offset: int, default, partition_by, order_by) -> DataFrame:
    part = as_list(partition_by)
    need(df, [column, *part])
    out = scan.shifted(df, part, scan.need_order(df, order_by), {column: name}, offset)
    value = F.coalesce(col(name), F.lit(default).cast(df.schema[column].dataType)) if default is not None else col(name)
    return out.withColumn(name, F.when(_known(part), value))


def lag(df: DataFrame, column: str, new_column: str | None = None, offset: int = 1, default=None, partition_by=None,
        order_by=None) -> DataFrame:
    """Value ``offset`` rows back; the default also replaces a null found there."""
    return _shift(df, column, new_column or f"{column}_lag_{offset}", offset, default, partition_by, order_by)


def lead(df: DataFrame, column: str, new_column: str | None = None, offset: int = 1, default=None, partition_by=None,
         order_by=None) -> DataFrame:
    return _shift(df, column, new_column or f"{column}_lead_{offset}", -offset, default, partition_by, order_by)


def lag_lead(df: DataFrame, target_columns, periods: int = 1, partition_by=None, suffix: str | None = None, fill_value=None,
             order_by=None) -> DataFrame:
    """Older shift: the sign gives the direction, the fill is used past the edge only."""
    suffix = suffix if suffix is not None else (f"_lag{periods}" if periods >= 0 else f"_lead{-periods}")
    part = as_list(partition_by)
    names = {c: f"{c}{suffix}" for c in existing(df, target_columns)}
    return scan.shifted(df, part, scan.need_order(df, order_by), names, periods, fill_value) if names else df


def moving_average(df: DataFrame, column: str, window: int, new_column: str | None = None, min_periods: int = 1,
                   center: bool = False, partition_by=None, order_by=None) -> DataFrame:
    """Rolling mean of ``window`` rows; nulls are skipped, fewer than ``min_periods`` values give null."""
    if window < 1:
        raise OpError("window must be at least 1")
    part = as_list(partition_by)
    need(df, [column, *part])
    before, after = (window // 2, (window - 1) // 2) if center else (window - 1, 0)
    out = scan.moving_sums(df, part, scan.need_order(df, order_by), num(df, column), before, after, "__sum", "__cnt")
    enough = (F.col("__cnt") >= min_periods) & (F.col("__cnt") > 0) & _known(part)
    return out.withColumn(new_column or f"{column}_ma_{window}", F.when(enough, F.col("__sum") / F.col("__cnt"))).drop("__sum", "__cnt")


def first_value(df: DataFrame, column: str, partition_by, new_column: str | None = None, order_by=None, ascending: bool = True,
                tie_break=None) -> DataFrame:
    """First non-null value of each group in order, on every row. One aggregate row per group is joined back."""
    part = as_list(partition_by)
    names = as_list(order_by)
    need(df, [column, *part, *names])
    keys = [scan.Key(c, ascending, False) for c in names] + scan.keys_of(tie_break)
    if not keys:
        raise OpError("order_by is required")
    at = F.when(col(column).isNotNull(), F.struct(*[scan._sort_value(df, k).alias(f"s{i}") for i, k in enumerate(keys)]))
    stats = df.where(_known(part)).groupBy(*[col(p) for p in part]).agg(F.min_by(col(column), at).alias("__first"))
    return attach(df, stats, part).withColumn(new_column or f"{column}_first", F.col("__first")).drop("__first")


def normalize(df: DataFrame, target_columns, method: str = "minmax", suffix: str | None = None) -> DataFrame:
    """Min-max or z-score scaling of numeric columns; a constant column becomes 0. One scalar subquery."""
    one_of("method", method, ("minmax", "zscore"))
    names = [c for c in existing(df, target_columns) if is_numeric(df, c)]
    if not names:
        return df
    aggs = []
    for i, c in enumerate(names):
        x = num(df, c)
        a, b = (F.min(x), F.max(x) - F.min(x)) if method == "minmax" else (F.avg(x), F.stddev(x))
        aggs += [a.alias(f"a{i}"), b.alias(f"b{i}")]
    row = df.agg(F.struct(*aggs).alias("s")).scalar()
    out = {}
    for i, c in enumerate(names):
        a, b = row[f"a{i}"], row[f"b{i}"]
        scaled = F.when(F.coalesce(b, F.lit(0.0)) != 0, (num(df, c) - a) / F.nullif(b, F.lit(0.0))).otherwise(
            F.lit(0.0))
        out[f"{c}{suffix}" if suffix else c] = F.when(col(c).isNotNull(), scaled)
    return df.withColumns(out)


def outlier_bounds(df: DataFrame, column: str, threshold_method: str, lower_percentile: float, upper_percentile: float) -> tuple[Column, Column]:
    x = num(df, column)
    if threshold_method == "zscore":
        row = df.agg(F.struct(F.avg(x).alias("m"), F.stddev(x).alias("s")).alias("r")).scalar()
        return row["m"] - 3 * row["s"], row["m"] + 3 * row["s"]
    probs = [0.25, 0.75] if threshold_method == "iqr" else [lower_percentile / 100, upper_percentile / 100]
    row = quantiles.quantiles(df, [], column, probs).select(F.struct("q0", "q1").alias("r")).scalar()
    if threshold_method == "percentile":
        return row["q0"], row["q1"]
    spread = row["q1"] - row["q0"]
    return row["q0"] - 1.5 * spread, row["q1"] + 1.5 * spread


def handle_outliers(df: DataFrame, target_columns, method: str = "cap", threshold_method: str = "iqr",
                    lower_percentile: float = 1, upper_percentile: float = 99) -> DataFrame:
    """Cap, remove, flag or null values outside iqr (1.5), zscore (3) or percentile bounds.

    Columns go in sequence: after a removal the next bounds see the remaining rows.
    """
    one_of("method", method, ("cap", "remove", "flag", "replace_null"))
    one_of("threshold_method", threshold_method, ("iqr", "zscore", "percentile"))
    source = df
    for c in existing(df, target_columns):
        if not is_numeric(df, c):
            continue
        if method == "remove":
            source = df = scan.settle(df) if df is not source else df
        low, high = outlier_bounds(source, c, threshold_method, lower_percentile, upper_percentile)
        x = num(df, c)
        outside = F.coalesce((x < low) | (x > high), F.lit(False))
        if method == "cap":
            df = df.withColumn(c, F.when(x.isNotNull(), F.least(F.greatest(x, low), high)))
        elif method == "remove":
            df = df.where(~outside)  # the next column's bounds see the remaining rows
        elif method == "flag":
            df = df.withColumn(f"{c}_outlier", outside)
        else:
            df = df.withColumn(c, F.when(~outside, col(c)))
    return df
