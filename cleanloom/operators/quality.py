"""Quality and drift operators. Transforms stay lazy; ``*_metrics`` give the counts as a small frame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import quantiles, scan, textfn
from ..functions.core import (OpError, as_list, attach, col, existing, is_numeric, is_string, is_temporal, need, num, one_of,
                              per_column, rows_frame, text, type_class)
from ..functions.dates import parse_any
from ..functions.similarity import rename_score
from .columns import FALSE_WORDS, TRUE_WORDS, cast_expr
from .format import mapped

# named patterns of validate_pattern, tested from the start of the text (fixed values)
PATTERN_TYPES = {
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "phone": r"^[\d\s\(\)\-\+\.]{7,20}$",
    "url": r"^https?://[^\s/$.?#].[^\s]*$",
    "date": r"^\d{1,4}[-/]\d{1,2}[-/]\d{1,4}$",
    "zipcode": r"^\d{5}(-\d{4})?$",
    "ssn": r"^\d{3}-\d{2}-\d{4}$",
}

# named formats of detect_format_drift (fixed values)
FORMAT_TYPES = {
    "date_iso": r"^\d{4}-\d{2}-\d{2}$",
    "date_us": r"^\d{1,2}/\d{1,2}/\d{2,4}$",
    "date_eu": r"^\d{1,2}\.\d{1,2}\.\d{2,4}$",
    "phone_us": r"^(\+1)?[\s\.-]?\(?\d{3}\)?[\s\.-]?\d{3}[\s\.-]?\d{4}$",
    "phone_intl": r"^\+\d{1,3}[\s\.-]?\d{4,14}$",
    "uuid": r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
}

# named formats of validate_format (fixed values)
VALIDATION_FORMATS = {
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "phone_us": r"^[\+]?[(]?[0-9]{3}[)]?[-\s\.]?[0-9]{3}[-\s\.]?[0-9]{4}$",
    "phone_intl": r"^\+?[1-9]\d{1,14}$",
    "url": r"^https?://[^\s]+$",
    "zipcode_us": r"^\d{5}(-\d{4})?$",
    "ssn": r"^\d{3}-\d{2}-\d{4}$",
    "credit_card": r"^\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}$",
    "ip_address": r"^(\d{1,3}\.){3}\d{1,3}$",
    "date_iso": r"^\d{4}-\d{2}-\d{2}$",
    "date_us": r"^\d{2}/\d{2}/\d{4}$",
    "uuid": r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    "alphanumeric": r"^[a-zA-Z0-9]+$",
    "numeric": r"^-?\d+\.?\d*$",
}

# words of normalize_boolean (fixed values)
BOOLEAN_TRUE = ("yes", "y", "true", "t", "1", "on", "1.0")
BOOLEAN_FALSE = ("no", "n", "false", "f", "0", "off", "0.0", "")

# words infer_types takes for booleans (fixed values)
INFER_BOOLEAN = ("true", "false", "yes", "no", "1", "0", "t", "f", "y", "n")


# nulls ---------------------------------------------------------------------

def detect_nulls(df: DataFrame, columns=None, add_null_flag: bool = False, add_null_count: bool = False) -> DataFrame:
    names = as_list(columns) or list(df.columns)
    need(df, names)
    nulls = None
    for c in names:
        one = col(c).isNull().cast("int")
        nulls = one if nulls is None else nulls + one
    if add_null_flag:
        df = df.withColumn("_has_null", nulls > 0)
    if add_null_count:
        df = df.withColumn("_null_count", nulls)
    return df


def null_metrics(df: DataFrame, columns=None, threshold: float | None = None) -> DataFrame:
    """Per column: null_count, null_rate, over_threshold. One pass."""
    names = as_list(columns) or list(df.columns)
    need(df, names)
    out = per_column(df, {c: {"null_count": F.count_if(col(c).isNull()), "rows": F.count(F.lit(1))} for c in names})
    rate = F.coalesce(F.try_divide(F.col("null_count"), F.col("rows")), F.lit(0.0))
    over = F.lit(False) if threshold is None else rate > F.lit(float(threshold))
    return out.select("column", "null_count", F.bround(rate, 4).alias("null_rate"), over.alias("over_threshold"))


def null_summary(df: DataFrame, columns=None) -> DataFrame:
    """One row: rows, rows_with_null, null_cells, overall_null_rate."""
    names = as_list(columns) or list(df.columns)
    flagged = detect_nulls(df.select(*[col(c) for c in names]), names, add_null_count=True)
    out = flagged.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_null_count") > 0).alias("rows_with_null"),
                      F.coalesce(F.sum("_null_count"), F.lit(0)).alias("null_cells"))
    return out.withColumn("overall_null_rate", F.bround(F.coalesce(
        F.try_divide(F.col("null_cells"), F.col("rows") * len(names)), F.lit(0.0)), 4))


# profile of one column -------------------------------------------------------

def profile_column(df: DataFrame, column: str, include_percentiles: bool = True) -> DataFrame:
    """One row of statistics with the issue flags high_null, all_unique, constant."""
    need(df, [column])
    c = col(column)
    aggs = [F.lit(column).alias("column"), F.lit(type_class(df.schema[column].dataType)).alias("dtype"),
            F.count(F.lit(1)).alias("row_count"), F.count_if(c.isNull()).alias("null_count"), F.count_distinct(c).alias("unique_count")]
    numeric = is_numeric(df, column)
    if numeric:
        x = num(df, column)
        aggs += [F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev(x).alias("std"), F.sum(x).alias("sum")]
    else:
        n = F.length(text(df, column))
        aggs += [F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.avg(n).alias("avg_length")]
    out = df.agg(*aggs)
    if numeric and include_percentiles:
        row = quantiles.quantiles(df, [], column, [0.25, 0.5, 0.75]).select(F.struct("q0", "q1", "q2").alias("r")).scalar()
        out = out.withColumns({"p25": row["q0"], "p50": row["q1"], "p75": row["q2"]})
    filled = F.col("row_count") - F.col("null_count")
    return out.withColumns({
        "high_null": F.coalesce(F.try_divide(F.col("null_count"), F.col("row_count")) > 0.5, F.lit(False)),
        "all_unique": (F.col("unique_count") == F.col("row_count")) & (F.col("row_count") > 1),
        "constant": (F.col("unique_count") == 1) & (filled > 0),
    })


def top_values(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """The n most frequent non-null values; ties by value."""
    need(df, [column])
    out = df.where(col(column).isNotNull()).groupBy(col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    return out.orderBy(F.col("count").desc(), F.col("value")).limit(n)


# patterns --------------------------------------------------------------------

def _anchored(df: DataFrame, column: str, pattern: str) -> Column:
    return F.coalesce(text(df, column).rlike(f"^(?:{pattern})"), F.lit(False))


def _pick_pattern(pattern, pattern_type, table: Mapping[str, str]) -> str:
    if pattern:
        return pattern
    if not pattern_type:
        raise OpError("give a pattern or a named type")
    if pattern_type not in table:
        raise OpError(f"unknown type {pattern_type!r}")
    return table[pattern_type]


def validate_pattern(df: DataFrame, column: str, pattern: str | None = None, pattern_type: str | None = None,
                     add_valid_flag: bool = True, new_column: str | None = None) -> DataFrame:
    need(df, [column])
    p = _pick_pattern(pattern, pattern_type, PATTERN_TYPES)
    return df.withColumn(new_column or f"{column}_valid", _anchored(df, column, p)) if add_valid_flag else df


def pattern_metrics(df: DataFrame, column: str, pattern: str | None = None, pattern_type: str | None = None) -> DataFrame:
    need(df, [column])
    ok = _anchored(df, column, _pick_pattern(pattern, pattern_type, PATTERN_TYPES))
    out = df.agg(F.count_if(ok).alias("valid_count"), F.count_if(~ok).alias("invalid_count"))
    rows = F.col("valid_count") + F.col("invalid_count")
    return out.withColumn("valid_rate", F.bround(F.coalesce(F.try_divide(F.col("valid_count"), rows), F.lit(0.0)), 4))


def invalid_samples(df: DataFrame, column: str, pattern: str | None = None, pattern_type: str | None = None, n: int = 5,
                    order_by=None) -> DataFrame:
    """The first n values that fail the pattern."""
    p = _pick_pattern(pattern, pattern_type, PATTERN_TYPES)
    bad = df.where(col(column).isNotNull() & ~_anchored(df, column, p))
    keys = scan.keys_of(order_by) or [scan.Key(column)]
    return bad.orderBy(*[k.column() for k in keys]).limit(n).select(col(column))


def validate_format(df: DataFrame, target_columns, format_type: str = "email", pattern: str | None = None, suffix: str = "_valid",
                    invalid_action: str = "flag") -> DataFrame:
    """Older pattern check: flag, null or remove what does not match."""
    one_of("invalid_action", invalid_action, ("flag", "null", "remove"))
    p = pattern or VALIDATION_FORMATS.get(format_type, ".*")
    for c in existing(df, target_columns):
        ok = _anchored(df, c, p)
        if invalid_action == "flag":
            df = df.withColumn(f"{c}{suffix}", ok)
        elif invalid_action == "null":
            df = df.withColumn(c, F.when(ok, col(c)))
        else:
            df = df.where(ok)
    return df


# duplicates --------------------------------------------------------------------

def is_duplicate(df: DataFrame, subset=None, keep="first", new_column: str = "_is_duplicate", order_by=None) -> DataFrame:
    """Flag rows after the first (or before the last) of their group; ``none`` flags every row of a repeated group."""
    subset = as_list(subset) or list(df.columns)
    need(df, subset)
    keep = "none" if keep in (False, None) else keep
    one_of("keep", keep, ("first", "last", "none"))
    if keep == "none":
        counts = df.groupBy(*[col(c) for c in subset]).agg(F.count(F.lit(1)).alias("__n"))
        return attach(df, counts, subset).withColumn(new_column, F.col("__n") > 1).drop("__n")
    keys = scan.need_order(df, order_by)
    out = scan.number(df, subset, keys if keep == "first" else [k.flipped() for k in keys], "__rn")
    return out.withColumn(new_column, F.col("__rn") > 1).drop("__rn")


# schema ------------------------------------------------------------------------

def schema_rows(df: DataFrame) -> DataFrame:
    """(position, column, type_class, spark_type) of a frame."""
    rows = [(i, f.name, type_class(f.dataType), f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return rows_frame(df.sparkSession, rows, "position int, column string, type_class string, spark_type string")


def _wide_class(name: str) -> str:
    return {"integer": "number", "float": "number", "double": "number", "numeric": "number", "datetime": "date"}.get(name, name)


def validate_schema(df: DataFrame, expected_columns=None, expected_types: Mapping[str, str] | None = None,
                    allow_extra_columns: bool = True, case_sensitive: bool = False) -> DataFrame:
    """Rows (kind, column, expected, observed): missing, extra and type problems. No row: the schema is valid."""
    fold = (lambda s: s) if case_sensitive else (lambda s: s.lower())
    have = {fold(f.name): f for f in df.schema.fields}
    rows = []
    wanted = list(expected_columns or (expected_types or {}))
    for c in wanted:
        if fold(c) not in have:
            rows.append(("missing", c, c, None))
    if not allow_extra_columns and wanted:
        names = {fold(c) for c in wanted}
        rows += [("extra", f.name, None, f.name) for k, f in have.items() if k not in names]
    for c, t in (expected_types or {}).items():
        f = have.get(fold(c))
        if f is not None and _wide_class(type_class(f.dataType)) != _wide_class(t):
            rows.append(("type", f.name, _wide_class(t), _wide_class(type_class(f.dataType))))
    return rows_frame(df.sparkSession, rows, "kind string, column string, expected string, observed string")


def compare_schemas(df: DataFrame, expected_columns, expected_types: Mapping[str, str] | None = None,
                    expected_nullable: Mapping[str, bool] | None = None, case_sensitive: bool = False) -> DataFrame:
    """Drift rows (kind, column, expected, observed): missing, extra, type, and nulls where none are allowed."""
    fold = (lambda s: s) if case_sensitive else (lambda s: s.lower())
    have = {fold(f.name): f for f in df.schema.fields}
    wanted = {fold(c) for c in expected_columns}
    rows = [("missing", c, c, None) for c in expected_columns if fold(c) not in have]
    rows += [("extra", f.name, None, f.name) for k, f in have.items() if k not in wanted]
    for c, t in (expected_types or {}).items():
        f = have.get(fold(c))
        if f is not None and type_class(f.dataType) != t:
            rows.append(("type", f.name, t, type_class(f.dataType)))
    out = rows_frame(df.sparkSession, rows, "kind string, column string, expected string, observed string")
    strict = [have[fold(c)].name for c, ok in (expected_nullable or {}).items() if not ok and fold(c) in have]
    if strict:
        nulls = per_column(df, {c: {"n": F.count_if(col(c).isNull())} for c in strict}).where("n > 0")
        out = out.unionByName(nulls.select(F.lit("nullable").alias("kind"), "column", F.lit("no nulls").alias("expected"),
                                           F.concat(F.col("n").cast("string"), F.lit(" nulls")).alias("observed")))
    return out


def detect_renamed_columns(df: DataFrame, expected_columns, similarity_threshold: float = 0.6,
                           check_type_compatibility: bool = True) -> DataFrame:
    """For each missing expected column the most similar extra one: expected, observed, name_similarity, confidence, observed_type."""
    have = {c.lower() for c in df.columns}
    missing = [c for c in expected_columns if c.lower() not in have]
    names = {c.lower() for c in expected_columns}
    extra = [f for f in df.schema.fields if f.name.lower() not in names]
    schema = "expected string, observed string, name_similarity double, confidence string, observed_type string"
    if not missing or not extra:
        return rows_frame(df.sparkSession, [], schema)
    base = rows_frame(df.sparkSession, [(m,) for m in missing], "expected string")
    options = F.array(*[F.struct(F.lit(f.name).alias("name"), F.lit(i).alias("at"), F.lit(type_class(f.dataType)).alias("kind"))
                        for i, f in enumerate(extra)])
    scored = F.transform(options, lambda o: F.struct(
        rename_score(F.lower(F.col("expected")), F.lower(o["name"])).alias("score"), (-o["at"]).alias("at"),
        o["name"].alias("name"), o["kind"].alias("kind")))
    best = base.withColumn("best", F.array_max(scored)).where(F.col("best.score") >= similarity_threshold)
    s = F.col("best.score")
    return best.select("expected", F.col("best.name").alias("observed"), F.bround(s, 3).alias("name_similarity"),
                       F.when(s > 0.8, "high").when(s > 0.6, "medium").otherwise("low").alias("confidence"),
                       (F.col("best.kind") if check_type_compatibility else F.lit(None).cast("string")).alias("observed_type"))


# type inference -------------------------------------------------------------------

def infer_types(df: DataFrame, columns=None, sample_size: int | None = None, order_by=None) -> DataFrame:
    """Rows (column, current_type, inferred_type, confidence) from one pass over all rows,
    or over the first ``sample_size`` rows in ``order_by`` order."""
    names = as_list(columns) or list(df.columns)
    need(df, names)
    if sample_size is not None:
        keys = scan.need_order(df, order_by)
        df = df.orderBy(*[k.column() for k in keys]).limit(sample_size)
    stats = {}
    for c in names:
        kind = type_class(df.schema[c].dataType)
        filled = F.count(col(c))
        if kind != "string":
            word = F.lit({"boolean": "boolean"}.get(kind, kind))
            stats[c] = {"current": F.lit(kind), "n": filled, "words": F.lit(0).cast("bigint"), "ints": F.lit(0).cast("bigint"),
                        "nums": F.lit(0).cast("bigint"), "dates": F.lit(0).cast("bigint"), "known": F.max(word)}
            continue
        s = textfn.strip(text(df, c))
        number = s.try_cast("double").isNotNull()
        stats[c] = {
            "current": F.lit("string"), "n": filled,
            "words": F.count_if(F.lower(s).isin(*INFER_BOOLEAN) | (s == "")),
            "ints": F.count_if(number & ~s.contains(".")), "nums": F.count_if(number),
            "dates": F.count_if(parse_any(df, c).isNotNull()), "known": F.lit(None).cast("string"),
        }
    out = per_column(df, stats)
    n = F.col("n")
    share = F.try_divide(F.col("dates"), n)
    kind = (F.when(n == 0, "unknown").when(F.col("known").isNotNull(), F.col("known")).when(F.col("words") == n, "boolean")
            .when((F.col("nums") == n) & (F.col("ints") == n), "integer").when(F.col("nums") == n, "float")
            .when(share > 0.8, "datetime").otherwise("string"))
    sure = (F.when(n == 0, 0.0).when(F.col("known").isNotNull(), 1.0).when(F.col("words") == n, 0.95)
            .when(F.col("nums") == n, 0.9).when(share > 0.8, share).otherwise(0.8))
    return out.select("column", F.col("current").alias("current_type"), kind.alias("inferred_type"), F.bround(sure, 4).alias("confidence"))


def convert_inferred(df: DataFrame, columns=None) -> DataFrame:
    """Cast every text column to its inferred type (one inference pass first)."""
    found = {r["column"]: r["inferred_type"] for r in infer_types(df, columns).collect()}  # one row per column
    new = {}
    for c, t in found.items():
        if t in ("unknown", "string") or type_class(df.schema[c].dataType) != "string":
            continue
        new[c] = F.coalesce(F.lower(textfn.strip(col(c))).isin(*TRUE_WORDS), F.lit(False)) if t == "boolean" else cast_expr(df, c, t)
    return df.withColumns(new) if new else df


# drift ------------------------------------------------------------------------------

def detect_enum_drift(df: DataFrame, column: str, expected_values: Sequence, case_sensitive: bool = False) -> DataFrame:
    """The frame with ``<column>_enum_drift``; a null cell counts as drift."""
    need(df, [column])
    s = text(df, column)
    known = [str(v) if case_sensitive else str(v).lower() for v in expected_values]
    return df.withColumn(f"{column}_enum_drift", ~F.coalesce((s if case_sensitive else F.lower(s)).isin(known), F.lit(False)))


def enum_metrics(df: DataFrame, column: str, expected_values: Sequence, case_sensitive: bool = False) -> DataFrame:
    """Rows (value, kind, count): kind new or missing."""
    need(df, [column])
    s = text(df, column)
    key = s if case_sensitive else F.lower(s)
    seen = df.where(col(column).isNotNull()).groupBy(key.alias("__key")).agg(F.count(F.lit(1)).alias("count"), F.min(s).alias("__value"))
    want = rows_frame(df.sparkSession, [(v,) for v in sorted({str(v) if case_sensitive else str(v).lower() for v in expected_values})],
                      "__want string")
    both = seen.join(want, F.col("__key") == F.col("__want"), "full").where("__key is null or __want is null")
    return both.select(F.coalesce("__value", "__want").alias("value"),
                       F.when(F.col("__key").isNull(), "missing").otherwise("new").alias("kind"),
                       F.coalesce("count", F.lit(0)).alias("count"))


def format_metrics(df: DataFrame, column: str, expected_format: str | None = None, format_type: str | None = None) -> DataFrame:
    """Rows (format, match_count, match_rate) over all non-null values: the expected format,
    then every named format among the values that do not match it."""
    need(df, [column])
    p = _pick_pattern(expected_format, format_type, FORMAT_TYPES)
    s = text(df, column)
    ok = s.rlike(f"(?i)^(?:{p})")
    named = {"expected": F.count_if(ok), **{k: F.count_if(~ok & s.rlike(f"(?i)^(?:{v})")) for k, v in FORMAT_TYPES.items()}}
    out = per_column(df.where(col(column).isNotNull()), {k: {"match_count": v, "rows": F.count(F.lit(1))} for k, v in named.items()})
    rate = F.bround(F.coalesce(F.try_divide(F.col("match_count"), F.col("rows")), F.lit(0.0)), 4)
    return out.where("column = 'expected' or match_count > 0").select(F.col("column").alias("format"), "match_count", rate.alias("match_rate"))


NUMERIC_STATS = ("mean", "std", "min", "max", "p25", "p50", "p75")


def numeric_stats(df: DataFrame, column: str) -> DataFrame:
    """Rows (metric, value) of the seven drift statistics."""
    need(df, [column])
    x = num(df, column)
    one = df.agg(F.avg(x).alias("mean"), F.stddev(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    row = quantiles.quantiles(df, [], column, [0.25, 0.5, 0.75]).select(F.struct("q0", "q1", "q2").alias("r")).scalar()
    one = one.withColumns({"p25": row["q0"], "p50": row["q1"], "p75": row["q2"]})
    return one.unpivot([], [F.col(c) for c in NUMERIC_STATS], "metric", "value")


def distribution_drift(df: DataFrame, column: str, baseline_stats: Mapping[str, float] | None = None,
                       baseline_distribution: Mapping[str, float] | None = None, drift_threshold: float = 0.1) -> DataFrame:
    """Rows (metric, baseline, observed, difference, drifted). Numbers compare statistics by
    relative difference, other columns compare shares of values by absolute difference."""
    need(df, [column])
    spark = df.sparkSession
    if is_numeric(df, column) and baseline_stats:
        base = rows_frame(spark, [(k, float(v)) for k, v in baseline_stats.items() if v], "metric string, baseline double")
        both = numeric_stats(df, column).join(base, "metric")
        diff = F.abs(F.col("value") - F.col("baseline")) / F.abs(F.col("baseline"))
        return both.select("metric", "baseline", F.bround("value", 4).alias("observed"), F.bround(diff, 4).alias("difference"),
                           (diff > drift_threshold).alias("drifted"))
    if not baseline_distribution:
        raise OpError("a baseline is required")
    seen = value_shares(df, column)
    base = rows_frame(spark, [(str(k), float(v)) for k, v in baseline_distribution.items()], "__m string, baseline double")
    both = seen.join(base, F.col("metric") == F.col("__m"), "full")
    b, o = F.coalesce("baseline", F.lit(0.0)), F.coalesce("share", F.lit(0.0))
    diff = F.bround(F.abs(o - b), 4)
    return both.select(F.coalesce("metric", "__m").alias("metric"), b.alias("baseline"), o.alias("observed"), diff.alias("difference"),
                       (diff > drift_threshold).alias("drifted"))


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Rows (metric, share): every value's part of the non-null rows, to 4 places."""
    counts = df.where(col(column).isNotNull()).groupBy(text(df, column).alias("metric")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(col(column)).alias("t")).scalar()
    return counts.select("metric", F.bround(F.col("n") / total, 4).alias("share"))


def drift_score(drift: DataFrame) -> DataFrame:
    """One row: drift_score (mean difference), drifted_metrics, has_drift."""
    return drift.agg(F.bround(F.coalesce(F.avg("difference"), F.lit(0.0)), 4).alias("drift_score"),
                     F.count_if("drifted").alias("drifted_metrics"),
                     F.coalesce(F.bool_or("drifted"), F.lit(False)).alias("has_drift"))


# normalising ---------------------------------------------------------------------------

def normalize_boolean(df: DataFrame, column: str, true_values=None, false_values=None, output_format: str = "boolean",
                      null_handling: str = "keep") -> DataFrame:
    """Word sets to boolean, 1/0 or 'true'/'false'; unknown words are null."""
    need(df, [column])
    one_of("output_format", output_format, ("boolean", "integer", "string"))
    one_of("null_handling", null_handling, ("keep", "true", "false"))
    clean = lambda vs: [str(v).lower().strip() for v in vs]
    w = F.lower(textfn.strip(text(df, column)))
    b = F.when(w.isin(clean(true_values or BOOLEAN_TRUE)), True).when(w.isin(clean(false_values or BOOLEAN_FALSE)), False)
    if null_handling != "keep":
        b = F.when(col(column).isNull(), null_handling == "true").otherwise(b)
    out = {"boolean": b, "integer": b.cast("int"), "string": b.cast("string")}[output_format]
    return df.withColumn(column, out)


def boolean_metrics(df: DataFrame, column: str, true_values=None, false_values=None) -> DataFrame:
    need(df, [column])
    b = normalize_boolean(df.select(col(column), col(column).alias("__raw")), column, true_values, false_values)
    c, raw = col(column), F.col("__raw")
    return b.agg(F.count_if(c).alias("true_count"), F.count_if(~c).alias("false_count"), F.count_if(raw.isNull()).alias("null_count"),
                 F.count_if(raw.isNotNull() & c.isNull()).alias("unknown_count"))


def normalize_enum_values(df: DataFrame, column: str, mapping: Mapping[str, str], case_sensitive: bool = False,
                          unmapped_handling: str = "keep") -> DataFrame:
    """Variants to canonical values; unmapped cells are kept, nulled, or fail the job."""
    need(df, [column])
    one_of("unmapped_handling", unmapped_handling, ("keep", "null", "error"))
    out, to = mapped(df, column, {**{v: v for v in mapping.values()}, **mapping}, case_sensitive)
    s = text(df, column)
    value = F.col(to)
    if unmapped_handling == "keep":
        value = F.coalesce(value, s)
    elif unmapped_handling == "error":
        value = F.when(value.isNull() & s.isNotNull(), F.raise_error(F.concat(F.lit("unmapped value: "), s)).cast("string")).otherwise(value)
    return out.select(*[value.alias(c) if c == column else col(c) for c in df.columns])


# report -------------------------------------------------------------------------------

def generate_drift_report(df: DataFrame, expected_columns=None, expected_types: Mapping[str, str] | None = None,
                          enum_columns: Mapping[str, Sequence] | None = None,
                          baseline_stats: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """All drift checks as rows (check, column, expected, observed, counts, recommendation).

    Enum drift has one row per value. ``counts`` marks the checks that make up the
    severity; see ``report_summary``.
    """
    spark = df.sparkSession
    actual = {c.lower(): c for c in df.columns}
    rows = []
    expected = list(expected_columns or [])
    for c in expected:
        if c.lower() not in actual:
            rows.append(("missing", c, c, None, True, f"add column {c} with a default or map it from another column"))
    names = {c.lower() for c in expected}
    if expected:
        rows += [("extra", c, None, c, False, None) for c in df.columns if c.lower() not in names]
    for c, t in (expected_types or {}).items():
        if c.lower() in actual:
            seen = type_class(df.schema[actual[c.lower()]].dataType)
            if seen != t:
                rows.append(("type", c, t, seen, True, f"cast column {c} from {seen} to {t}"))
    schema = "check string, column string, expected string, observed string, counts boolean, recommendation string"
    out = rows_frame(spark, rows, schema)
    if expected:
        renames = detect_renamed_columns(df, expected)
        out = out.unionByName(renames.select(
            F.lit("renamed").alias("check"), F.col("expected").alias("column"), "expected", "observed", F.lit(False).alias("counts"),
            F.concat(F.lit("rename "), "observed", F.lit(" to "), "expected").alias("recommendation")))
    for c, values in (enum_columns or {}).items():
        if c.lower() in actual:
            m = enum_metrics(df, actual[c.lower()], values)
            new = F.col("kind") == "new"
            out = out.unionByName(m.select(
                F.lit("enum").alias("check"), F.lit(c).alias("column"), F.when(~new, F.col("value")).alias("expected"),
                F.when(new, F.lower("value")).alias("observed"), F.lit(True).alias("counts"),
                F.when(new, "map the new value or extend the list").alias("recommendation")))
    for c, stats in (baseline_stats or {}).items():
        if c.lower() in actual and is_numeric(df, actual[c.lower()]):
            x = num(df, actual[c.lower()])
            parts = []
            one = df.agg(F.avg(x).alias("mean"), F.stddev(x).alias("std"))
            for k in ("mean", "std"):
                if stats.get(k):
                    off = F.abs(F.col(k) - F.lit(float(stats[k]))) / abs(float(stats[k])) > 0.1
                    parts.append(F.when(off, F.lit(k)))
            if parts:
                found = one.select(F.concat_ws(",", *parts).alias("observed")).where("observed != ''")
                out = out.unionByName(found.select(
                    F.lit("distribution").alias("check"), F.lit(c).alias("column"), F.lit("baseline").alias("expected"), "observed",
                    F.lit(True).alias("counts"), F.lit(None).cast("string").alias("recommendation")))
    return out


def report_summary(report: DataFrame) -> DataFrame:
    """One row: total_drifts and severity (missing column critical, type high, over 3 medium, else low)."""
    total = F.count_distinct(F.when(F.col("counts"), F.struct("check", "column")))
    return report.agg(
        total.alias("total_drifts"),
        F.when(total == 0, "none").when(F.count_if(F.col("check") == "missing") > 0, "critical")
        .when(F.count_if(F.col("check") == "type") > 0, "high").when(total > 3, "medium").otherwise("low").alias("severity"))
