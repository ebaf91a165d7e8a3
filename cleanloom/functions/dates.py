"""Reading dates in mixed layouts and writing them with strftime patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .core import OpError, col, is_string, is_temporal

# (shape of the text, layout), tried in this order. Month first: d/M/yyyy only takes days above 12.
# The shape keeps a layout's parser away from text it cannot read.
DAY, CLOCK, CLOCK_S, AMPM = r"\d{1,2}", r"\d{1,2}:\d{2}", r"\d{1,2}:\d{2}:\d{2}", r"\d{1,2}:\d{2} [AaPp][Mm]"
MONTH = r"[A-Za-z]{3,9}"
MIXED_LAYOUTS = (
    (r"\d{4}-\d{2}-\d{2}", "yyyy-MM-dd"),
    (rf"\d{{4}}-\d{{2}}-\d{{2}} {CLOCK_S}", "yyyy-MM-dd HH:mm:ss"),
    (rf"\d{{4}}-\d{{2}}-\d{{2}} {CLOCK}", "yyyy-MM-dd HH:mm"),
    (rf"\d{{4}}-\d{{2}}-\d{{2}}T{CLOCK_S}", "yyyy-MM-dd'T'HH:mm:ss"),
    (rf"\d{{4}}-\d{{2}}-\d{{2}}T{CLOCK}", "yyyy-MM-dd'T'HH:mm"),
    (rf"\d{{4}}-\d{{2}}-\d{{2}} {CLOCK_S}\.\d{{1,6}}", "yyyy-MM-dd HH:mm:ss.[SSSSSS][SSSSS][SSSS][SSS][SS][S]"),
    (rf"\d{{4}}/{DAY}/{DAY}", "yyyy/M/d"),
    (rf"\d{{4}}/{DAY}/{DAY} {CLOCK}", "yyyy/M/d H:mm"),
    (rf"\d{{4}}/{DAY}/{DAY} {CLOCK_S}", "yyyy/M/d H:mm:ss"),
    (rf"{DAY}/{DAY}/\d{{4}}", "M/d/yyyy"),
    (rf"{DAY}/{DAY}/\d{{4}} {CLOCK}", "M/d/yyyy H:mm"),
    (rf"{DAY}/{DAY}/\d{{4}} {AMPM}", "M/d/yyyy h:mm a"),
    (rf"{DAY}/{DAY}/\d{{4}} {CLOCK_S}", "M/d/yyyy H:mm:ss"),
    (rf"{DAY}/{DAY}/\d{{2}}", "M/d/yy"),
    (rf"{DAY}/{DAY}/\d{{2}} {CLOCK}", "M/d/yy H:mm"),
    (rf"{DAY}/{DAY}/\d{{2}} {AMPM}", "M/d/yy h:mm a"),
    (rf"{DAY}-{DAY}-\d{{4}}", "M-d-yyyy"),
    (rf"{DAY}-{DAY}-\d{{4}} {CLOCK}", "M-d-yyyy H:mm"),
    (rf"{MONTH} {DAY} \d{{4}}", "MMM d yyyy"),
    (rf"{MONTH} {DAY}, \d{{4}}", "MMM d, yyyy"),
    (rf"{MONTH} {DAY} \d{{4}}", "MMMM d yyyy"),
    (rf"{MONTH} {DAY}, \d{{4}}", "MMMM d, yyyy"),
    (rf"{MONTH} {DAY} \d{{4}} {AMPM}", "MMMM d yyyy h:mm a"),
    (rf"{MONTH} {DAY}, \d{{4}} {AMPM}", "MMMM d, yyyy h:mm a"),
    (rf"{DAY} {MONTH} \d{{4}}", "d MMM yyyy"),
    (rf"{DAY} {MONTH} \d{{4}}", "d MMMM yyyy"),
    (rf"{DAY}-{MONTH}-\d{{4}}", "d-MMM-yyyy"),
    (rf"{DAY}/{DAY}/\d{{4}}", "d/M/yyyy"),
    (rf"{DAY}/{DAY}/\d{{4}} {CLOCK}", "d/M/yyyy H:mm"),
    (rf"{DAY}\.{DAY}\.\d{{4}}", "d.M.yyyy"),
    (r"\d{8}", "yyyyMMdd"),
)

# strftime letter -> Java pattern
STRFTIME = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss",
    "p": "a", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "f": "SSSSSS", "%": "%",
}


def java_pattern(fmt: str) -> str:
    """A strftime pattern as a Spark datetime pattern; other letters are quoted."""
    out, letters, i = [], "", 0
    while i <= len(fmt):
        ch = fmt[i] if i < len(fmt) else ""
        if ch.isalpha():  # a run of plain letters is quoted as one
            letters, i = letters + ch, i + 1
            continue
        if letters:
            out.append(f"'{letters}'")
            letters = ""
        if ch == "%" and i + 1 < len(fmt):
            if fmt[i + 1] not in STRFTIME:
                raise OpError(f"date directive %{fmt[i + 1]} is not supported")
            out.append(STRFTIME[fmt[i + 1]])
            i += 2
            continue
        out.append("''" if ch == "'" else ch)
        i += 1
    return "".join(out)


def parse_text(value: Column, layouts=MIXED_LAYOUTS) -> Column:
    """First layout that fits, as a timestamp without zone; else null."""
    clean = F.trim(value)
    tries = [F.when(clean.rlike(f"^{shape}$"), F.try_to_timestamp(clean, F.lit(layout))) for shape, layout in layouts]
    return F.coalesce(*tries).cast("timestamp_ntz")


def parse_any(df: DataFrame, name: str, layout: str | None = None, layouts=MIXED_LAYOUTS) -> Column:
    """A date, timestamp or text column as timestamp_ntz; unreadable text is null."""
    if is_temporal(df, name):
        return col(name).cast("timestamp_ntz")
    value = col(name) if is_string(df, name) else col(name).cast("string")
    if layout:
        return F.try_to_timestamp(F.trim(value), F.lit(java_pattern(layout))).cast("timestamp_ntz")
    return parse_text(value, layouts)


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.unix_micros(ts.cast("timestamp"))
