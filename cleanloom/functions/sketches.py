"""Mergeable sketches of columns: distinct values (theta) and numbers (KLL), by Spark's own aggregates.

A theta sketch keeps the 2**LOG_ENTRIES smallest hashes of a column's distinct values. Up to so many distinct values it is exact;
beyond, a count has a relative standard error of 2**(-LOG_ENTRIES / 2), and the overlap of two columns, as a share of their union,
has an absolute one of at most half of that. A KLL sketch of K gives ranks within RANK_ERROR of the true ones. Sketches of parts of
a table merge to those of the whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .core import col, is_numeric

LOG_ENTRIES = 12
#: Parameter of the sketches of numbers, and the error of ranks at it with a certainty of 99 %.
K, RANK_ERROR = 400, 0.0075


def plain_value(value: Column) -> Column:
    """Values that count as one: trimmed and lower-cased."""
    return F.lower(F.trim(value.cast("string")))


def sketch_values(value: Column) -> Column:
    """Aggregate: the sketch of the distinct values."""
    return F.theta_sketch_agg(plain_value(value), LOG_ENTRIES)


def distinct_values(sketch: Column) -> Column:
    return F.theta_sketch_estimate(sketch)


def overlap(a: Column, b: Column) -> Column:
    """Values of both columns as a share of the values of either; 0 without values."""
    both = F.theta_sketch_estimate(F.theta_union(a, b, LOG_ENTRIES))
    shared = F.theta_sketch_estimate(F.theta_intersection(a, b))
    return F.when(a.isNull() | b.isNull() | (both == 0), 0.0).otherwise(shared / both)


def merged_values(a: Column, b: Column) -> Column:
    """The sketch of the values of two parts, either of which may be missing."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.theta_union(a, b, LOG_ENTRIES))


def sketch_numbers(number: Column) -> Column:
    return F.kll_sketch_agg_double(number.cast("double"), K)


def merged_numbers(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.kll_sketch_merge_double(a, b))


def quantile(sketch: Column, share: float) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(share))


NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


def column_sketches(df: DataFrame) -> DataFrame:
    """One row per column of what can be merged: rows, filled cells, and of finite numbers their count, range, mean and sum of squares
    about the mean (``m2``); the sketches of values and of numbers. One pass, and a task sends one row. Nested columns are only counted.
    """
    each = []
    for i, name in enumerate(df.columns):
        kind = df.schema[name].dataType
        number = F.lit(None).cast("double")
        if is_numeric(df, name):
            number = F.when(F.abs(col(name).cast("double")) < float("inf"), col(name).cast("double"))
        each.append(F.struct(
            F.lit(i).alias("position"), F.lit(name).alias("column"), F.count(F.lit(1)).alias("row_count"), F.count(col(name)).alias("filled"),
            F.count(number).alias("numbers"), F.min(number).alias("min_value"), F.max(number).alias("max_value"), F.avg(number).alias("mean"),
            (F.var_pop(number) * F.count(number)).alias("m2"),
            (F.lit(None).cast("binary") if isinstance(kind, NESTED) else F.when(F.count(col(name)) > 0, sketch_values(col(name)))).alias("values_sketch"),
            (F.when(F.count(number) > 0, sketch_numbers(number)) if is_numeric(df, name) else F.lit(None).cast("binary")).alias("numbers_sketch")))
    return df.agg(F.array(*each).alias("each")).select(F.inline("each"))


def merged_sketches(a: DataFrame, b: DataFrame) -> DataFrame:
    """The column sketches of two parts of one table, from those of the parts: no row of either is read."""
    y = b.select([F.col(c).alias(f"_{c}") for c in b.columns])
    both = a.join(y, a["column"] == y["_column"])
    n, m = F.col("numbers"), F.col("_numbers")
    share = F.try_divide(m, n + m)
    apart = F.col("_mean") - F.col("mean")
    mean = F.coalesce(F.col("mean") + apart * share, "mean", "_mean")
    m2 = F.coalesce(F.col("m2") + F.col("_m2") + apart * apart * n * share, "m2", "_m2")
    return both.select(
        "position", "column", *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in ("row_count", "filled", "numbers")],
        F.least("min_value", "_min_value").alias("min_value"), F.greatest("max_value", "_max_value").alias("max_value"), mean.alias("mean"), m2.alias("m2"),
        merged_values(F.col("values_sketch"), F.col("_values_sketch")).alias("values_sketch"),
        merged_numbers(F.col("numbers_sketch"), F.col("_numbers_sketch")).alias("numbers_sketch"))


def sketched_profile(sketches: DataFrame) -> DataFrame:
    """What the column sketches say: null cells, distinct values and median within the sketches' errors, range, mean and deviation."""
    filled = F.col("numbers") > 0
    return sketches.select(
        "position", "column", "row_count", (F.col("row_count") - F.col("filled")).alias("null_count"),
        F.coalesce(F.round(distinct_values(F.col("values_sketch"))).cast("bigint"), F.lit(0)).alias("unique_count"), "min_value", "max_value",
        F.bround("mean", 4).alias("mean"), F.bround(F.sqrt(F.when(F.col("numbers") > 1, F.col("m2") / (F.col("numbers") - 1))), 4).alias("std"),
        F.when(filled, quantile(F.col("numbers_sketch"), 0.5)).alias("median"))
