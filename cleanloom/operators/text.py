"""Text operators. Null stays null; ``string_contains`` of null is false."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import textfn
from ..functions.core import (OpError, as_list, col, existing, is_string, java_replacement, need, need_new, one_of,
                              quote_literal, string_columns, text)

# Python's string.punctuation (fixed value)
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# entities decoded in this order (fixed values)
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"))

REGEX_HINTS = "[]*+?^$\\|()"


def _pattern(pattern: str, case_sensitive: bool = True) -> str:
    try:
        re.compile(pattern)
    except re.error as e:
        raise OpError(f"bad pattern {pattern!r}: {e}") from None
    return pattern if case_sensitive else f"(?i){pattern}"


def find_replace(df: DataFrame, column: str, find: str, replace: str, use_regex: bool = False, case_sensitive: bool = True) -> DataFrame:
    need(df, [column])
    s = text(df, column)
    if use_regex:
        new = F.regexp_replace(s, _pattern(find, case_sensitive), java_replacement(replace))
    elif case_sensitive:
        new = F.replace(s, F.lit(find), F.lit(replace)) if find else s
    else:
        plain = replace.replace("\\", "\\\\").replace("$", "\\$")
        new = F.regexp_replace(s, "(?i)" + quote_literal(find), plain)
    return df.withColumn(column, new)


def replace_values(df: DataFrame, target_columns=None, old_value=None, new_value="", regex: bool = False) -> DataFrame:
    """Older replace: whole cells, or a regex when asked for or when the text looks like one."""
    names = existing(df, target_columns) or list(df.columns)
    as_regex = regex or (isinstance(old_value, str) and any(c in old_value for c in REGEX_HINTS))
    for c in names:
        if as_regex:
            if is_string(df, c):
                df = df.withColumn(c, F.regexp_replace(col(c), _pattern(str(old_value)), java_replacement(str(new_value))))
        elif isinstance(old_value, str) == is_string(df, c):
            df = df.withColumn(c, F.when(col(c) == F.lit(old_value), F.lit(new_value)).otherwise(col(c)))
    return df


def extract_text(df: DataFrame, column: str, new_column: str, method: str, start: int = 0, end: int | None = None,
                 pattern: str | None = None, delimiter: str | None = None, delimiter2: str | None = None) -> DataFrame:
    """Slice, first regex group, text before the first / after the last delimiter, or between two."""
    need(df, [column])
    need_new(df, [new_column])
    one_of("method", method, ("position", "regex", "before", "after", "between"))
    s = text(df, column)
    if method == "position":
        out = textfn.py_slice(s, start, end)
    elif method == "regex":
        if not pattern:
            raise OpError("pattern required")
        out = F.when(s.rlike(_pattern(pattern)), F.regexp_extract(s, pattern, 1))
    elif method == "between":
        if not delimiter or not delimiter2:
            raise OpError("both delimiters required")
        p = f"{quote_literal(delimiter)}(.*?){quote_literal(delimiter2)}"
        out = F.when(s.rlike(p), F.regexp_extract(s, p, 1))
    else:
        if not delimiter:
            raise OpError("delimiter required")
        out = F.element_at(F.split(s, textfn.splitter(delimiter)), 1 if method == "before" else -1)
    return df.withColumn(new_column, out)


def extract_pattern(df: DataFrame, target_columns, pattern: str, new_column: str = "{column}_extracted") -> DataFrame:
    """First regex group, or the whole match when the pattern has no group."""
    group = 1 if re.compile(_pattern(pattern)).groups else 0
    for c in existing(df, target_columns):
        s = text(df, c)
        df = df.withColumn(new_column.replace("{column}", c), F.when(s.rlike(pattern), F.regexp_extract(s, pattern, group)))
    return df


def text_length(df: DataFrame, column: str, new_column: str, count_spaces: bool = True) -> DataFrame:
    need(df, [column])
    s = text(df, column)
    return df.withColumn(new_column, F.length(s if count_spaces else F.replace(s, F.lit(" "), F.lit(""))))


def _padded(s: Column, width: int, fill: str, side: str) -> Column:
    short = F.length(s) < width
    if side == "left":
        return F.when(short, F.lpad(s, width, fill)).otherwise(s)
    if side == "right":
        return F.when(short, F.rpad(s, width, fill)).otherwise(s)
    gap = F.lit(width) - F.length(s)
    left = F.floor(gap / 2) + F.when((gap % 2 == 1) & (F.lit(width) % 2 == 1), 1).otherwise(0)
    return F.when(short, F.concat(F.repeat(F.lit(fill), left.cast("int")), s, F.repeat(F.lit(fill), (gap - left).cast("int")))).otherwise(s)


def pad_text(df: DataFrame, column, length: int, pad_char: str = "0", side: str = "left") -> DataFrame:
    """Pad to a length; longer text is never cut."""
    one_of("side", side, ("left", "right", "both"))
    if len(pad_char) != 1:
        raise OpError("pad_char must be one character")
    names = as_list(column)
    need(df, names)
    return df.withColumns({c: _padded(text(df, c), length, pad_char, side) for c in names})


def remove_characters(df: DataFrame, column: str, characters: str | None = None, remove_type: str | None = None) -> DataFrame:
    need(df, [column])
    s = text(df, column)
    if characters:
        return df.withColumn(column, F.translate(s, characters, ""))
    if remove_type == "punctuation":
        return df.withColumn(column, F.translate(s, PUNCTUATION, ""))
    patterns = {"digits": r"\d", "letters": r"[a-zA-Z]", "whitespace": textfn.WHITE}
    if remove_type not in patterns:
        raise OpError("give characters or remove_type digits, letters, punctuation or whitespace")
    return df.withColumn(column, F.regexp_replace(s, patterns[remove_type], ""))


def string_contains(df: DataFrame, column: str, substring: str, new_column: str | None = None, case_sensitive: bool = False,
                    regex: bool = False) -> DataFrame:
    need(df, [column])
    s = text(df, column)
    if regex:
        hit = s.rlike(_pattern(substring, case_sensitive))
    elif case_sensitive:
        hit = s.contains(substring)
    else:
        hit = F.lower(s).contains(substring.lower())
    return df.withColumn(new_column or f"{column}_contains", F.coalesce(hit, F.lit(False)))


def substring(df: DataFrame, column: str, start: int = 0, length: int | None = None, new_column: str | None = None) -> DataFrame:
    """0-based; a negative start counts from the end."""
    need(df, [column])
    end = None if length is None else start + length
    return df.withColumn(new_column or column, textfn.py_slice(text(df, column), start, end))


def substring_columns(df: DataFrame, target_columns, start: int | None = None, end: int | None = None, before: str | None = None,
                      after: str | None = None, suffix: str = "_substr", create_new: bool = False) -> DataFrame:
    """Older substring: slice, text before the first or after the last delimiter, in place or beside."""
    for c in existing(df, target_columns):
        s = text(df, c)
        if before is not None:
            v = F.element_at(F.split(s, textfn.splitter(before)), 1)
        elif after is not None:
            v = F.element_at(F.split(s, textfn.splitter(after)), -1)
        else:
            v = textfn.py_slice(s, start, end)
        df = df.withColumn(f"{c}{suffix}" if create_new else c, v)
    return df


def regex_replace(df: DataFrame, column: str, pattern: str, replacement: str, new_column: str | None = None,
                  case_sensitive: bool = True) -> DataFrame:
    need(df, [column])
    new = F.regexp_replace(text(df, column), _pattern(pattern, case_sensitive), java_replacement(replacement))
    return df.withColumn(new_column or column, new)


def regex_extract(df: DataFrame, column: str, pattern: str, new_column: str, group: int = 0, case_sensitive: bool = True) -> DataFrame:
    """First match; no match or no such group gives null."""
    need(df, [column])
    p = _pattern(pattern, case_sensitive)
    s = text(df, column)
    if group > re.compile(pattern).groups:
        return df.withColumn(new_column, F.lit(None).cast("string"))
    return df.withColumn(new_column, F.when(s.rlike(p), F.regexp_extract(s, p, group)))


def clean_text(df: DataFrame, target_columns, keep_spaces: bool = True, keep_punctuation: bool = False, lowercase: bool = False) -> DataFrame:
    """Keep ASCII letters and digits, and on request spaces and ``.,!?``."""
    kept = "a-zA-Z0-9" + (r"\s" if keep_spaces else "") + (".,!?" if keep_punctuation else "")
    for c in existing(df, target_columns):
        v = F.regexp_replace(text(df, c), f"[^{kept}]", "")
        df = df.withColumn(c, F.lower(v) if lowercase else v)
    return df


def remove_html(df: DataFrame, target_columns, decode_entities: bool = True) -> DataFrame:
    for c in existing(df, target_columns):
        v = F.regexp_replace(text(df, c), "<[^>]+>", "")
        if decode_entities:
            for entity, plain in ENTITIES:
                v = F.replace(v, F.lit(entity), F.lit(plain))
        df = df.withColumn(c, v)
    return df


def standardize(df: DataFrame, target_columns=None) -> DataFrame:
    """Trim and lower-case string columns."""
    names = existing(df, target_columns) if target_columns else string_columns(df)
    return df.withColumns({c: F.lower(textfn.strip(col(c))) for c in names if is_string(df, c)})


def mask_data(df: DataFrame, target_columns, method: str = "last_n", visible_chars: int = 4, mask_char: str = "*") -> DataFrame:
    """Hide all but the last, first or outer characters, everything, or an e-mail's local part."""
    one_of("method", method, ("last_n", "first_n", "middle", "all", "email"))
    v = int(visible_chars)
    for c in existing(df, target_columns):
        s = text(df, c)
        n = F.length(s)
        stars = lambda k: F.repeat(F.lit(mask_char), k.cast("int"))
        full = stars(n)
        if method == "last_n":
            out = F.when(n <= v, full).otherwise(F.concat(stars(n - v), F.right(s, F.lit(v))))
        elif method == "first_n":
            out = F.when(n <= v, full).otherwise(F.concat(F.left(s, F.lit(v)), stars(n - v)))
        elif method == "middle":
            out = F.when(n <= 2 * v, full).otherwise(F.concat(F.left(s, F.lit(v)), stars(n - 2 * v), F.right(s, F.lit(v))))
        elif method == "all":
            out = full
        else:
            at = F.instr(s, "@")
            local = F.when(at > 2, F.concat(F.substring(s, 1, 1), stars(at - 2))).otherwise(F.lit(mask_char))
            out = F.when(at > 0, F.concat(local, s.substr(at, n))).otherwise(full)
        df = df.withColumn(c, out)
    return df
