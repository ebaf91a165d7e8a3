"""Formatting operators: dates as text, phones, case, whitespace, value mapping."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import textfn
from ..functions.core import OpError, as_list, col, existing, is_string, need, one_of, string_columns, text
from ..functions.dates import java_pattern, parse_any

# phone layouts; {} takes three, three and four digits (fixed values)
PHONE_LAYOUTS = {
    "(XXX) XXX-XXXX": "({}) {}-{}",
    "XXX-XXX-XXXX": "{}-{}-{}",
    "XXXXXXXXXX": "{}{}{}",
    "+1 XXX-XXX-XXXX": "+1 {}-{}-{}",
}
OLD_PHONE_LAYOUTS = {
    "nnn-nnn-nnnn": "{}-{}-{}",
    "(nnn) nnn-nnnn": "({}) {}-{}",
    "nnn.nnn.nnnn": "{}.{}.{}",
    "nnnnnnnnnn": "{}{}{}",
    "+1-nnn-nnn-nnnn": "+1-{}-{}-{}",
}


def format_date(df: DataFrame, column, output_format: str = "%Y-%m-%d", input_format: str | None = None) -> DataFrame:
    """Any-layout date as text in a strftime layout; unreadable text is null."""
    names = as_list(column)
    need(df, names)
    out = java_pattern(output_format)
    return df.withColumns({c: F.date_format(parse_any(df, c, input_format), out) for c in names})


def format_phone(df: DataFrame, column: str, format: str = "(XXX) XXX-XXXX", country_code: str = "1") -> DataFrame:
    """Ten-digit numbers in a layout; other numbers stay as they are."""
    need(df, [column])
    one_of("format", format, tuple(PHONE_LAYOUTS))
    layout = PHONE_LAYOUTS[format]
    if format.startswith("+"):
        layout = f"+{country_code} " + layout.split(" ", 1)[1]
    s = text(df, column)
    digits = textfn.phone_digits(s, keep_last_ten=True)
    return df.withColumn(column, F.when(F.length(digits) == 10, textfn.phone_layout(digits, layout)).otherwise(s))


def format_phone_columns(df: DataFrame, target_columns, output_format: str = "nnn-nnn-nnnn", country_code: str | None = None) -> DataFrame:
    """Older phone layouts; only a leading 1 of eleven digits is dropped."""
    layout = OLD_PHONE_LAYOUTS.get(output_format, OLD_PHONE_LAYOUTS["nnn-nnn-nnnn"])
    if country_code and not output_format.startswith("+"):
        layout = f"{country_code}-{layout}"
    for c in existing(df, target_columns):
        s = text(df, c)
        digits = textfn.phone_digits(s, keep_last_ten=False)
        df = df.withColumn(c, F.when(F.length(digits) == 10, textfn.phone_layout(digits, layout)).otherwise(s))
    return df


def change_text_casing(df: DataFrame, column, case: str) -> DataFrame:
    names = as_list(column)
    need(df, names)
    fns = {"lower": F.lower, "upper": F.upper, "title": textfn.title, "sentence": textfn.sentence, "capitalize": textfn.sentence}
    one_of("case", case, tuple(fns))
    return df.withColumns({c: fns[case](text(df, c)) for c in names})


def change_case(df: DataFrame, target_columns, case_type: str = "lower") -> DataFrame:
    return change_text_casing(df, [c for c in existing(df, target_columns) if is_string(df, c)], case_type)


def trim_whitespace(df: DataFrame, columns=None, trim_type: str = "all") -> DataFrame:
    """leading, trailing, both, or all (ends, and inner runs to one space)."""
    one_of("trim_type", trim_type, ("leading", "trailing", "both", "all"))
    if columns:
        need(df, as_list(columns))
    names = [c for c in (as_list(columns) or string_columns(df)) if is_string(df, c)]

    def cut(c: Column) -> Column:
        if trim_type == "leading":
            return F.regexp_replace(c, rf"^{textfn.WHITE}+", "")
        if trim_type == "trailing":
            return F.regexp_replace(c, rf"{textfn.WHITE}+$", "")
        s = textfn.strip(c)
        return F.regexp_replace(s, rf"{textfn.WHITE}+", " ") if trim_type == "all" else s

    return df.withColumns({c: cut(col(c)) for c in names})


def trim_columns(df: DataFrame, target_columns=None) -> DataFrame:
    """Older trim: ends only."""
    return trim_whitespace(df, existing(df, target_columns) or None, "both")


# a mapping of at most this many entries becomes a literal map; a larger one is joined
LITERAL_MAP = 200


def mapped(df: DataFrame, column: str, mapping: Mapping[str, str], case_sensitive: bool) -> tuple[DataFrame, str]:
    """Add ``__to``: the value the cell maps to, or null. Later entries win on equal keys."""
    if not mapping:
        raise OpError("mapping is empty")
    fold = (lambda v: str(v)) if case_sensitive else (lambda v: str(v).lower())
    table = {fold(k): (None if v is None else str(v)) for k, v in mapping.items()}
    key = text(df, column) if case_sensitive else F.lower(text(df, column))
    if len(table) <= LITERAL_MAP:
        pairs = [F.lit(x) for kv in table.items() for x in kv]
        return df.withColumn("__to", F.try_element_at(F.create_map(*pairs), key)), "__to"
    side = df.sparkSession.createDataFrame(list(table.items()), "`__from` string, `__to` string")
    return df.withColumn("__key", key).join(side, F.col("__key") == F.col("__from"), "left").drop("__key", "__from"), "__to"


def standardize_values(df: DataFrame, column: str, mapping: Mapping[str, str], case_sensitive: bool = False) -> DataFrame:
    """Variants to a standard value; others stay."""
    need(df, [column])
    out, to = mapped(df, column, mapping, case_sensitive)
    return out.select(*[F.coalesce(F.col(to), text(df, column)).alias(c) if c == column else col(c) for c in df.columns])
