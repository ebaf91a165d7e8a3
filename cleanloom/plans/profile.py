"""Column profiles of whole tables, any number of them in one job.

The rows of all tables become one long relation (file, column, value), counted in one shuffle and written. Totals, uniques, text
flags, pattern hits, top values, samples, moments, quartiles, outliers and the sketch of a column's values all come from the
counted values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import quantiles, scan, textfn
from ..functions.core import as_list, col, is_numeric, need, numeric_columns, rows_frame, text, type_class
from ..functions.sketches import sketch_values

# value patterns, in order of preference, with the semantic type and the layout they stand for (fixed values)
PATTERNS = (
    ("email", r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$", "email", "email@domain.com"),
    ("url", r"^https?://[^\s]+$", "url", "https://..."),
    ("phone_us", r"^[\+]?[(]?[0-9]{3}[)]?[-\s\.]?[0-9]{3}[-\s\.]?[0-9]{4,6}$", "phone", "(XXX) XXX-XXXX"),
    ("phone_intl", r"^\+?[1-9]\d{1,14}$", "phone", "+X XXX XXX XXXX"),
    ("zipcode_us", r"^\d{5}(-\d{4})?$", "zipcode", "XXXXX or XXXXX-XXXX"),
    ("date_iso", r"^\d{4}-\d{2}-\d{2}$", "date", "YYYY-MM-DD"),
    ("date_us", r"^\d{1,2}/\d{1,2}/\d{2,4}$", "date", "MM/DD/YYYY"),
    ("date_eu", r"^\d{1,2}\.\d{1,2}\.\d{2,4}$", "date", "DD.MM.YYYY"),
    ("datetime_iso", r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}", "datetime", "YYYY-MM-DD HH:MM:SS"),
    ("time", r"(?i)^\d{1,2}:\d{2}(:\d{2})?(\s?[AP]M)?$", "time", "HH:MM:SS"),
    ("currency", r"^[$€£¥]\s?[\d,]+\.?\d*$|^[\d,]+\.?\d*\s?[$€£¥]$", "currency", "$X,XXX.XX"),
    ("percentage", r"^-?\d+\.?\d*\s?%$", "percentage", "XX.X%"),
    ("boolean", r"(?i)^(true|false|yes|no|y|n|1|0)$", "boolean", "true/false"),
)

# characters of which a value has one, if it has the pattern: looked for before the pattern (fixed values)
MARKS = {"email": "@", "url": ":", "date_us": "/", "date_eu": ".", "datetime_iso": ":", "time": ":", "currency": "$€£¥", "percentage": "%"}

# words of a boolean column (fixed values)
BOOLEAN_WORDS = ("true", "false", "yes", "no", "y", "n", "1", "0", "t", "f")

# parts of names that hint at a name column (fixed values)
NAME_HINTS = ("name", "first", "last", "customer", "user")

# a type's name in profiles and contracts (fixed values)
DTYPES = {"integer": "int64", "float": "float64", "boolean": "bool", "datetime": "datetime64[ns]", "string": "object"}


KEY = ("file", "column")


def value_counts(df: DataFrame, columns=None) -> DataFrame:
    """(column, value, count) of all non-null values, as text."""
    names = as_list(columns) or list(df.columns)
    return _counted({"": df.select(*[col(c) for c in names])}).where("value IS NOT NULL").select("column", "value", "count")


def _counted(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(file, column, value, number, count) of all values as text, null among them; ``number`` is the value of a numeric column."""
    long = None
    for file, df in tables.items():
        pairs = [F.struct(F.lit(c).alias("column"), text(df, c).alias("value"), (col(c).cast("double") if is_numeric(df, c) else F.lit(None).cast("double")).alias("number"))
                 for c in df.columns]
        if not pairs:
            continue
        one = df.select(F.lit(file).alias("file"), F.inline(F.array(*pairs)))
        long = one if long is None else long.unionByName(one)
    return long.groupBy(*KEY, "value").agg(F.max("number").alias("number"), F.count(F.lit(1)).alias("count"))


def counted(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The counted values as a written table, which every metric reads."""
    return scan.written(_counted({f: _plain(df) for f, df in tables.items()}))


def _keys(counts: DataFrame) -> list[str]:
    return [k for k in KEY if k in counts.columns]


def _merge(sides: Sequence[DataFrame]) -> DataFrame:
    """One row per key from frames with one row per key: a union and one small aggregate, no joins."""
    out = sides[0]
    for side in sides[1:]:
        out = out.unionByName(side, allowMissingColumns=True)
    keys = _keys(out)
    return out.groupBy(*keys).agg(*[F.first(c, ignorenulls=True).alias(c) for c in out.columns if c not in keys])


def _beside(counts: DataFrame, side: DataFrame, how: str = "inner") -> DataFrame:
    """Join a frame with a row for each column. It is broadcast: its few keys would send all values of a column to one task."""
    return counts.join(F.broadcast(side), _keys(counts), how)


def value_metrics(counts: DataFrame) -> DataFrame:
    """Per column, from its value counts: rows, uniques, text flags, pattern hits, boolean words, uniques without case."""
    v, n, clean = F.col("value"), F.col("count"), F.col("__clean")
    weigh = lambda test: F.coalesce(F.sum(F.when(test, n)), F.lit(0))
    may = {name: _any_in(clean, marks) for name, marks in MARKS.items()} | {"boolean": F.length(clean) <= 8}
    hits = [weigh(may[name] & clean.rlike(p) if name in may else clean.rlike(p)).alias(f"hit_{name}") for name, p, _, _ in PATTERNS]
    # the stripped value is a column of its own, so that it is made once for all tests
    return counts.withColumn("__clean", textfn.strip(v)).groupBy(*_keys(counts)).agg(
        F.sum(n).alias("row_count"), weigh(v.isNotNull()).alias("filled"), F.count(v).alias("unique_count"),
        weigh(v == "").alias("empty_string_count"), weigh((clean == "") & (v != "")).alias("whitespace_only_count"),
        weigh((clean != v) & (v != "")).alias("edge_whitespace_count"),
        F.bool_and((F.length(clean) <= 8) & F.lower(clean).isin(*BOOLEAN_WORDS)).alias("boolean_words"), F.bool_or(F.lower(v) != v).alias("cased"), *hits)


def _any_in(text: Column, marks: str) -> Column:
    """Whether one of the characters is in the text."""
    found = F.lit(False)
    for m in marks:
        found = found | text.contains(m)
    return found


def lower_uniques(counts: DataFrame) -> DataFrame:
    """Per column: distinct values ignoring case."""
    keys = _keys(counts)
    low = counts.where("value IS NOT NULL").groupBy(*keys, F.lower("value").alias("low")).agg(F.lit(1).alias("one"))
    return low.groupBy(*keys).agg(F.count(F.lit(1)).alias("unique_lower_count"))


def top_values(counts: DataFrame, total: Column | None = None, n: int = 10) -> DataFrame:
    """Per column: the n most frequent values as an array of (rank, value, count, percent); without ``total`` there is no percent.

    ``row_number <= n`` is pushed below the shuffle, so a column with very many
    values sends n rows per task.
    """
    keys = _keys(counts)
    w = Window.partitionBy(*keys).orderBy(F.col("count").desc(), F.col("value"))
    best = counts.where("value IS NOT NULL").withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n)
    percent = [] if total is None else [F.bround(F.col("count") / total * 100, 1).alias("percent")]
    cell = F.struct(F.col("__rn").alias("rank"), "value", "count", *percent)
    return best.groupBy(*keys).agg(F.sort_array(F.collect_list(cell)).alias("top_values"))


def samples(counts: DataFrame, n: int = 5) -> DataFrame:
    """Per column: n values with the smallest hash, the same ones wherever the value occurs."""
    keys = _keys(counts)
    known = counts.where("value IS NOT NULL").select(*keys, "value", F.xxhash64("value").alias("__h"))
    # the n-th of the least hashes of 256 classes: no sample has a larger hash, and few other values have smaller ones
    least = known.groupBy(*keys, F.pmod("__h", F.lit(256)).alias("__class")).agg(F.min("__h").alias("__h"))
    nth = least.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy("__h"))).where(F.col("__rn") <= n)
    most = nth.groupBy(*keys).agg(F.max("__h").alias("__most"), F.count(F.lit(1)).alias("__classes"))
    near = _beside(known, most).where((F.col("__h") <= F.col("__most")) | (F.col("__classes") < n))
    w = Window.partitionBy(*keys).orderBy("__h", "value")
    few = near.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n)
    return few.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__rn", "value"))).alias("s")).select(
        *keys, F.transform("s", lambda x: x["value"]).alias("sample_values"))


def value_sketches(counts: DataFrame) -> DataFrame:
    """Per column: the sketch of its distinct values, trimmed and lower-cased."""
    return counts.where("value IS NOT NULL").groupBy(*_keys(counts)).agg(sketch_values(F.col("value")).alias("values_sketch"))


STATISTICS = ("min_value", "max_value", "mean", "median", "std", "q1", "q3", "skewness", "outlier_count", "lower_bound", "upper_bound")


def ranges(counts: DataFrame) -> DataFrame:
    """Per numeric column with two values at least: its least and largest one."""
    return counts.where("number IS NOT NULL").groupBy(*_keys(counts)).agg(
        F.min("number").alias("min_value"), F.max("number").alias("max_value"), F.sum("count").alias("n")).where("n >= 2").drop("n")


def statistics(df: DataFrame, columns=None) -> DataFrame:
    """Per numeric column: min, max, mean, median, std, q1, q3, skewness (bias-corrected), outlier
    fences and count. Columns with fewer than two values have none."""
    names = as_list(columns) or numeric_columns(df)
    need(df, names)
    return _statistics(counted({"": df.select(*[col(c).cast("double").alias(c) for c in names])})).drop("file")


def _statistics(counts: DataFrame) -> DataFrame:
    """The statistics of all numeric columns, from the counted values: three small aggregates and exact quartiles."""
    keys = _keys(counts)
    numbers = counts.where("number IS NOT NULL").select(*keys, F.col("number").alias("x"), F.col("count").alias("c"))
    x, c = F.col("x"), F.col("c")
    first = numbers.groupBy(*keys).agg(F.sum(c).alias("n"), F.min(x).alias("min_value"), F.max(x).alias("max_value"), (F.sum(x * c) / F.sum(c)).alias("mean"))
    quart = quantiles.quantiles(numbers, keys, "x", [0.25, 0.5, 0.75], numbers.count(), weight="c")
    both = _merge([first, quart])
    spread = F.col("q2") - F.col("q0")
    # a row for each column, read twice: written, so that quartiles are found once
    both = scan.written(both.withColumn("lower_bound", F.col("q0") - 1.5 * spread).withColumn("upper_bound", F.col("q2") + 1.5 * spread))
    d = x - F.col("mean")
    # moments about the mean, and values outside the fences
    about = _beside(numbers, both.select(*keys, "mean", "lower_bound", "upper_bound")).groupBy(*keys).agg(
        F.sum(d * d * c).alias("m2"), F.sum(d * d * d * c).alias("m3"),
        F.coalesce(F.sum(F.when((x < F.col("lower_bound")) | (x > F.col("upper_bound")), c)), F.lit(0)).alias("outlier_count"))
    n = F.col("n").cast("double")
    out = _merge([both, about]).where("n >= 2")
    skew = F.when((n > 2) & (F.col("m2") > 0), F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)) * F.sqrt(n) * F.col("m3") / F.pow("m2", F.lit(1.5)))
    r4 = lambda e: F.bround(e, 4)
    return out.select(*keys, "min_value", "max_value", r4(F.col("mean")).alias("mean"), r4(F.col("q1")).alias("median"), r4(F.sqrt(F.col("m2") / (n - 1))).alias("std"),
                      r4(F.col("q0")).alias("q1"), r4(F.col("q2")).alias("q3"), r4(skew).alias("skewness"), "outlier_count",
                      F.when(spread > 0, r4(F.col("lower_bound"))).alias("lower_bound"), F.when(spread > 0, r4(F.col("upper_bound"))).alias("upper_bound"))


def semantic_type(name: Column, numeric: Column) -> Column:
    """(semantic_type, detected_pattern) from a column's name and its value metrics."""
    low = F.lower(name)
    filled = F.col("filled")
    unique = F.col("unique_count")
    id_name = low.isin("id", "uuid", "guid") | low.endswith("id")
    best = F.greatest(*[F.col(f"hit_{p}") for p, *_ in PATTERNS])
    pair = lambda kind, layout=None: F.struct(F.lit(kind).alias("semantic_type"), F.lit(layout).cast("string").alias("detected_pattern"))
    by_pattern = None
    for p, _, kind, layout in PATTERNS:
        test = F.col(f"hit_{p}") == best
        by_pattern = F.when(test, pair(kind, layout)) if by_pattern is None else by_pattern.when(test, pair(kind, layout))
    hinted = F.lit(False)
    for h in NAME_HINTS:
        hinted = hinted | low.contains(h)
    return (F.when(F.coalesce(filled, F.lit(0)) == 0, pair("unknown")).when(id_name & (unique == filled), pair("id"))
            .when(low.contains("email") | low.contains("e-mail"), pair("email", "email@domain.com"))
            .when((best > 0) & (best >= filled * 0.7), by_pattern).when(F.col("boolean_words"), pair("boolean", "true/false"))
            .when(numeric, pair("numeric")).when((unique / filled < 0.05) & (unique < 20), pair("category"))
            .when(hinted, pair("name")).otherwise(pair("unknown")))


def _plain(df: DataFrame) -> DataFrame:
    """The columns that hold single values."""
    return df.select(*[col(f.name) for f in df.schema.fields if f.dataType.typeName() not in ("array", "map", "struct", "binary", "variant")])


def _schema_rows(tables: Mapping[str, DataFrame]) -> DataFrame:
    spark = next(iter(tables.values())).sparkSession
    return rows_frame(spark, [(f, i, c, DTYPES[type_class(df.schema[c].dataType)]) for f, df in tables.items() for i, c in enumerate(df.columns)],
                      "file string, position int, column string, dtype string")


def meanings_of(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(file, position, column, dtype, semantic_type, sample_values, values_sketch): the part of a profile that matching
    reads, of all tables in one job."""
    tables = {f: _plain(df) for f, df in tables.items()}
    counts = counted(tables)
    out = _merge([_schema_rows(tables), value_metrics(counts), samples(counts), value_sketches(counts)])
    kind = semantic_type(F.col("column"), F.col("dtype").isin("int64", "float64"))
    return out.withColumn("__m", kind).select("file", "position", "column", "dtype", F.col("__m.semantic_type").alias("semantic_type"),
                                              F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"), "values_sketch")


def column_meanings(df: DataFrame) -> DataFrame:
    """``meanings_of`` one table."""
    return meanings_of({"": df}).drop("file")


def profile_table(df: DataFrame, quartiles: bool = True) -> DataFrame:
    """One row per column with everything the contract, matching and issue rules need; without ``quartiles`` only the range of numbers."""
    return profile_tables({"": df}, quartiles).drop("file")


def profile_tables(tables: Mapping[str, DataFrame], quartiles: bool = True) -> DataFrame:
    """One row per file and column: the profiles of any number of tables from one shuffle of their values."""
    tables = {f: _plain(df) for f, df in tables.items()}
    counts = counted(tables)
    metrics = scan.written(value_metrics(counts))  # a row for each column
    # case matters only where a value has some, and frequent values are shown only of columns with fewer than 50 values
    cased = _beside(counts, metrics.where("cased").select(*KEY), "left_semi")
    listed = _beside(counts, metrics.where("unique_count < 50").select(*KEY), "left_semi")
    sides = [_schema_rows(tables), metrics, lower_uniques(cased), samples(counts), top_values(listed), value_sketches(counts)]
    if any(is_numeric(df, c) for df in tables.values() for c in df.columns):
        sides.append(_statistics(counts) if quartiles else ranges(counts))
    out = _merge(sides).withColumn("row_count", F.coalesce("row_count", F.lit(0)))
    missing = {"min_value": "double", "max_value": "double", "mean": "double", "median": "double", "std": "double", "q1": "double", "q3": "double",
               "skewness": "double", "outlier_count": "bigint", "lower_bound": "double", "upper_bound": "double"}
    out = out.withColumns({c: F.lit(None).cast(k) for c, k in missing.items() if c not in out.columns})
    numeric = F.col("dtype").isin("int64", "float64")
    meaning = semantic_type(F.col("column"), numeric)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    texty = F.col("dtype") == "object"
    filled, unique, rows = zero("filled"), zero("unique_count"), F.col("row_count")
    out = out.withColumn("__m", meaning)
    cardinality = F.when(unique <= 10, "low").when(unique <= 100, "medium").otherwise("high")
    categorical = (unique <= 10) | ((unique <= 100) & F.coalesce(F.try_divide(unique, filled) < 0.5, F.lit(False)))
    shown = (F.col("__m.semantic_type") == "category") | (texty & (unique < 50))
    percent = lambda t: F.struct(t["rank"].alias("rank"), t["value"].alias("value"), t["count"].alias("count"), F.bround(t["count"] / F.col("row_count") * 100, 1).alias("percent"))
    out = out.withColumn("top_values", F.transform("top_values", percent))
    return out.select(
        "file", "position", "column", "dtype", F.col("__m.semantic_type").alias("semantic_type"), F.col("__m.detected_pattern").alias("detected_pattern"),
        "row_count", (rows - filled).alias("null_count"),
        F.bround(F.coalesce(F.try_divide((rows - filled) * 100, rows), F.lit(0.0)), 2).alias("null_percent"),
        F.when(texty, zero("empty_string_count")).otherwise(0).alias("empty_string_count"),
        F.when(texty, zero("whitespace_only_count")).otherwise(0).alias("whitespace_only_count"),
        F.when(texty, zero("edge_whitespace_count")).otherwise(0).alias("edge_whitespace_count"),
        unique.alias("unique_count"), F.coalesce("unique_lower_count", "unique_count", F.lit(0)).alias("unique_lower_count"),
        ((unique == filled) & (filled > 1)).alias("is_unique"), (filled - zero("hit_email")).alias("invalid_email_count"),
        F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"), "min_value", "max_value", "mean", "median",
        "std", "q1", "q3", "skewness", "outlier_count", "lower_bound", "upper_bound",
        F.when(shown, F.col("top_values")).alias("top_values"), F.when(shown, cardinality).alias("cardinality"),
        F.when(shown, categorical).alias("is_categorical"), "values_sketch")


def table_summary(df: DataFrame) -> DataFrame:
    """One row: rows, columns, duplicate rows and the severity of that, complete rows."""
    cells = F.struct(*[col(c) for c in df.columns])
    full = F.lit(True)
    for c in df.columns:
        full = full & col(c).isNotNull()
    out = df.groupBy(cells.alias("r")).agg(F.count(F.lit(1)).alias("n"), F.count_if(full).alias("ok")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.sum("ok"), F.lit(0)).alias("complete_rows"))
    share = F.try_divide(F.col("duplicate_rows") * 100, F.col("row_count"))
    return out.select("row_count", F.lit(len(df.columns)).alias("column_count"), "duplicate_rows", "complete_rows",
                      F.when(F.col("duplicate_rows") == 0, "none").when(share > 20, "critical").otherwise("warning").alias("severity"))


def column_issues(profile: DataFrame) -> DataFrame:
    """Issue rows (column, issue, severity, affected) of a profile."""
    pct = F.col("null_count") * 100 / F.nullif(F.col("row_count"), F.lit(0))
    filled = F.col("row_count") - F.col("null_count")
    out_pct = F.col("outlier_count") * 100 / F.nullif(F.col("row_count"), F.lit(0))
    texty = F.col("dtype") == "object"

    def issue(test: Column, name: str, severity, affected: Column) -> Column:
        s = severity if isinstance(severity, Column) else F.lit(severity)
        return F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(name).alias("issue"), s.alias("severity"), affected.cast("bigint").alias("affected")))

    found = F.array(
        issue(pct >= 50, "high_null_rate", "critical", F.col("null_count")),
        issue((pct >= 20) & (pct < 50), "missing_values", "warning", F.col("null_count")),
        issue(texty & (F.col("empty_string_count") > 0), "empty_strings", "warning", F.col("empty_string_count")),
        issue(texty & (F.col("edge_whitespace_count") > 0), "whitespace", "warning", F.col("edge_whitespace_count")),
        issue(texty & F.col("semantic_type").isin("category", "name", "unknown") & (F.col("unique_count") > F.col("unique_lower_count")),
              "inconsistent_casing", "warning", F.col("unique_count") - F.col("unique_lower_count")),
        issue((filled > 10) & F.col("upper_bound").isNotNull() & (F.col("outlier_count") > 0), "outliers",
              F.when(out_pct > 10, "critical").otherwise("info"), F.col("outlier_count")),
        issue((F.col("semantic_type") == "email") & (F.col("invalid_email_count") > 0), "invalid_values", "warning", F.col("invalid_email_count")),
    )
    return profile.select("column", F.inline(F.array_compact(found)))


def casing_examples(df: DataFrame, column: str, n: int = 3) -> DataFrame:
    """(low, variants): up to three spellings of the most frequent values that differ only in case."""
    counts = value_counts(df, [column])
    low = F.lower("value")
    groups = counts.groupBy(low.alias("low")).agg(F.sum("count").alias("count"), F.count(F.lit(1)).alias("spellings")).where("spellings > 1")
    best = groups.orderBy(F.col("count").desc(), "low").limit(n)
    w = Window.partitionBy("low").orderBy("value")
    few = counts.select(low.alias("low"), "value").join(best.select("low"), "low", "left_semi")
    few = few.withColumn("__rn", F.row_number().over(w)).where("__rn <= 3")
    return few.groupBy("low").agg(F.sort_array(F.collect_list("value")).alias("variants"))
