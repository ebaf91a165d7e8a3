"""Exact quantiles, modes and value ranks without holding a group in one buffer.

``percentile`` and ``mode`` keep every distinct value of a group in one map. Below
``SMALL`` counted rows that is fine. Above it the values are cut into chunks, the rows of the
chunks are added up, and only the chunks that hold a wanted position are counted by value (map-side
combined, so a hot value is one row) and sorted. Ranks number all counted values by a chunked running sum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import scan
from .core import attach, col

SMALL = 1_000_000


def small_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("cleanloom.quantile.smallRows", str(SMALL)))


def value_runs(df: DataFrame, part: Sequence[str], value: str, ascending: bool = True, weight: str | None = None) -> DataFrame:
    """One row per (group, value): rows with it (or their weights), rows before it, distinct values up to it."""
    counts = df.where(col(value).isNotNull()).groupBy(*[col(p) for p in part], col(value)).agg(
        (F.sum(col(weight)) if weight else F.count(F.lit(1))).alias("__cnt"))
    runs = scan.running(counts, list(part), [scan.Key(value, ascending)],
                        {"__cum": ("sum", F.col("__cnt")), "__dense": ("count", F.col("__cnt"))})
    return runs.withColumn("__before", F.col("__cum") - F.col("__cnt")).drop("__cum")


def quantiles(df: DataFrame, part: Sequence[str], value: str, probs: Sequence[float], rows: int | None = None, weight: str | None = None) -> DataFrame:
    """Per group: ``q0..qn`` (linear interpolation, as double) of the non-null values of ``value``, each taken ``weight`` times if given."""
    part = list(part)
    rows = df.count() if rows is None else rows
    x = col(value).cast("double")
    if rows <= small_limit(df):
        qs = F.percentile(x, F.array(*[F.lit(float(p)) for p in probs]), col(weight) if weight else F.lit(1))
        return df.groupBy(*[col(p) for p in part]).agg(qs.alias("__q")).select(
            *[col(p) for p in part], *[F.get("__q", F.lit(i)).alias(f"q{i}") for i in range(len(probs))])
    by = [col(p) for p in part]
    slim = df.where(x.isNotNull()).select(*by, x.alias("__x"), (col(weight) if weight else F.lit(1)).cast("bigint").alias("__w"))
    c = scan.chunked(slim, part, [scan.Key("__x")], rows)
    # rows of each chunk, and before it: only the chunks that hold a wanted position are sorted
    sums = c.df.groupBy(*by, col(c.chunk)).agg(F.sum("__w").alias("__cnt"))
    upto = c.group_window().rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("__n", F.sum("__cnt").over(Window.partitionBy(*(by or [F.lit(0)])))).withColumn("__before", F.sum("__cnt").over(upto) - F.col("__cnt"))
    wanted = F.lit(False)
    for p in probs:
        h = (F.col("__n") - 1) * F.lit(float(p))
        for pos in (F.floor(h), F.ceil(h)):
            wanted = wanted | ((F.col("__before") <= pos) & (pos < F.col("__before") + F.col("__cnt")))
    # written, so that its size is known to the join: a row for each wanted (group, chunk)
    chosen = scan.written(sums.where(wanted).select(*by, col(c.chunk), F.col("__n"), F.col("__before").alias("__first")))
    near = attach(c.df, chosen, [*part, c.chunk]).where("__n IS NOT NULL")
    counts = near.groupBy(*by, col(c.chunk), "__x", "__n", "__first").agg(F.sum("__w").alias("__cnt"))
    inside = Window.partitionBy(*by, col(c.chunk)).orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
    runs = counts.withColumn("__before", F.col("__first") + F.sum("__cnt").over(inside) - F.col("__cnt"))
    aggs: list[Column] = []
    for i, p in enumerate(probs):
        h = (F.col("__n") - 1) * F.lit(float(p))
        for tag, pos in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            hit = (F.col("__before") <= pos) & (pos < F.col("__before") + F.col("__cnt"))
            aggs.append(F.max(F.when(hit, F.col("__x"))).alias(f"__{tag}{i}"))
        aggs.append(F.max(h - F.floor(h)).alias(f"__f{i}"))
    picked = runs.groupBy(*[col(p) for p in part]).agg(*aggs)
    return picked.select(
        *[col(p) for p in part],
        *[_between(F.col(f"__lo{i}"), F.col(f"__hi{i}"), F.col(f"__f{i}")).alias(f"q{i}") for i in range(len(probs))])


def _between(lo: Column, hi: Column, part: Column) -> Column:
    """As ``percentile`` has it, so that both ways give the same: equal ends as they are, else a weighted sum, also of infinities."""
    return F.when(lo == hi, lo).otherwise((1 - part) * lo + part * hi)


def modes(df: DataFrame, part: Sequence[str], value: str, name: str) -> DataFrame:
    """Per group the most frequent non-null value; ties take the smallest."""
    by = [col(p) for p in part]
    counts = df.where(col(value).isNotNull()).groupBy(*by, col(value)).agg(F.count(F.lit(1)).alias("__cnt"))
    best = F.min(F.struct((-F.col("__cnt")).alias("c"), col(value).alias("v")))
    return counts.groupBy(*by).agg(best.alias("__m")).select(*by, F.col("__m.v").alias(name))
