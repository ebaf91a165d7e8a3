"""Date operators on timestamps, dates or text in mixed layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.core import OpError, as_list, col, existing, is_string, need, one_of
from ..functions.dates import micros, parse_any
from .columns import change_column_type

PARTS = ("year", "month", "day", "week", "quarter", "dayofweek", "dayofyear", "hour", "minute", "second", "weekday_name",
         "month_name", "daysinmonth", "is_weekend")
DAY_MICROS = 86_400_000_000


def _part(ts: Column, part: str) -> Column:
    one_of("part", part, PARTS)
    return {
        "year": lambda: F.year(ts), "month": lambda: F.month(ts), "day": lambda: F.dayofmonth(ts),
        "week": lambda: F.weekofyear(ts), "quarter": lambda: F.quarter(ts), "dayofweek": lambda: F.weekday(ts),
        "dayofyear": lambda: F.dayofyear(ts), "hour": lambda: F.hour(ts), "minute": lambda: F.minute(ts),
        "second": lambda: F.second(ts), "weekday_name": lambda: F.date_format(ts, "EEEE"),
        "month_name": lambda: F.date_format(ts, "MMMM"), "daysinmonth": lambda: F.dayofmonth(F.last_day(ts)),
        "is_weekend": lambda: F.weekday(ts) >= 5,
    }[part]()


def extract_date_part(df: DataFrame, column: str, part: str, new_column: str | None = None) -> DataFrame:
    need(df, [column])
    return df.withColumn(new_column or f"{column}_{part}", _part(parse_any(df, column), part))


def extract_date_parts(df: DataFrame, target_columns, parts=("year", "month", "day"), suffix: str = "_{part}") -> DataFrame:
    new = {}
    for c in existing(df, target_columns):
        ts = parse_any(df, c)
        for p in as_list(parts):
            new[c + suffix.replace("{part}", p)] = _part(ts, p)
    return df.withColumns(new) if new else df


def _difference(df: DataFrame, start: str, end: str, unit: str) -> Column:
    span = micros(parse_any(df, end)) - micros(parse_any(df, start))
    days = F.floor(span / DAY_MICROS)
    return {
        "days": lambda: days, "weeks": lambda: days / 7, "months": lambda: days / 30.44, "years": lambda: days / 365.25,
        "hours": lambda: span / 3_600_000_000, "minutes": lambda: span / 60_000_000, "seconds": lambda: span / 1_000_000,
    }[unit]()


UNITS = ("days", "weeks", "months", "years", "hours", "minutes", "seconds")


def date_diff(df: DataFrame, start_column: str, end_column: str, unit: str = "days", new_column: str | None = None,
              absolute: bool = False, rounded: bool = True) -> DataFrame:
    """end - start. Days are the floor of the duration; weeks, months (30.44) and years (365.25) round to 2."""
    need(df, [start_column, end_column])
    one_of("unit", unit, UNITS)
    d = _difference(df, start_column, end_column, unit)
    if absolute:
        d = F.abs(d)
    if rounded and unit in ("weeks", "months", "years"):
        d = F.bround(d, 2)
    return df.withColumn(new_column or f"{start_column}_to_{end_column}_{unit}", d)


def date_diff_columns(df: DataFrame, target_columns=None, start_column: str | None = None, end_column: str | None = None,
                      unit: str = "days", new_column: str = "date_diff", absolute: bool = True) -> DataFrame:
    """Older difference: absolute by default, never rounded; the first two targets stand in for start and end."""
    targets = as_list(target_columns)
    start = start_column or (targets[0] if targets else None)
    end = end_column or (targets[1] if len(targets) > 1 else None)
    if not start or not end:
        raise OpError("start and end columns are required")
    return date_diff(df, start, end, unit, new_column, absolute, rounded=False)


def _added(ts: Column, amount: int, unit: str) -> Column:
    n = F.lit(int(amount))
    if unit in ("months", "years"):
        step = F.make_ym_interval(n if unit == "years" else F.lit(0), n if unit == "months" else F.lit(0))
        return ts + step
    days = n * 7 if unit == "weeks" else n if unit == "days" else F.lit(0)
    zero = F.lit(0)
    return ts + F.make_dt_interval(days, n if unit == "hours" else zero, n if unit == "minutes" else zero,
                                   F.lit(float(amount)).cast("decimal(18,6)") if unit == "seconds" else F.lit(0).cast("decimal(18,6)"))


def date_add(df: DataFrame, column, amount: int, unit: str = "days", new_column: str | None = None) -> DataFrame:
    """Calendar add: month ends clamp."""
    one_of("unit", unit, UNITS)
    names = as_list(column)
    need(df, names)
    return df.withColumns({(new_column if new_column and len(names) == 1 else c): _added(parse_any(df, c), amount, unit) for c in names})


def date_to_epoch(df: DataFrame, target_columns, unit: str = "seconds", new_column: str | None = None) -> DataFrame:
    """Whole seconds, milliseconds or nanoseconds since 1970."""
    one_of("unit", unit, ("seconds", "milliseconds", "nanoseconds"))
    for c in existing(df, target_columns):
        us = micros(parse_any(df, c))
        v = us * 1000 if unit == "nanoseconds" else F.floor(us / (1_000_000 if unit == "seconds" else 1000))
        df = df.withColumn(new_column or f"{c}_epoch", v.cast("bigint"))
    return df


def parse_date(df: DataFrame, target_columns, format: str | None = None, errors: str = "coerce") -> DataFrame:
    for c in existing(df, target_columns):
        df = change_column_type(df, c, "datetime", format, errors)
    return df
