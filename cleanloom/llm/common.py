"""Helpers the operators share: reading, cutting lineage, running sums in a total order, words."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: White space between words, as a character class of Java and Python.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the place all executors share.

    The cluster names it in ``spark.checkpoint.dir``; where that is unset, the warehouse, which is shared as well, takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def cut(df: DataFrame, folder: str | None = None) -> DataFrame:
    """The frame as a written table: later steps start from files that outlive executors, and their size is known to the optimizer."""
    folder = folder or shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def kept_in_worker(name: str) -> dict:
    """A table that lives as long as the Python worker, for what is costly to prepare; its user bounds its size.

    Functions travel by value, so their modules' own variables begin anew with each task.
    """
    store = sys.modules.setdefault("_cleanloom_kept", types.ModuleType("_cleanloom_kept"))
    return store.__dict__.setdefault(name, {})


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for each row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text, an empty list for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def beside(docs: DataFrame, keep: list[Column] | None = None, /, **new: Column) -> DataFrame:
    """All columns of ``docs`` (or those in ``keep``) as one struct ``row``, with new columns beside it that can clash with none of them."""
    return docs.select(F.struct(*(keep or [docs[f"`{c}`"] for c in docs.columns])).alias("row"), *[c.alias(n) for n, c in new.items()])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running(df: DataFrame, group: Sequence[str], order: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Adds ``rank`` (from 0) and ``<c>_before`` (sum of column c over earlier rows) within each group, in the given order.

    Rows are range-partitioned by (group, order), so that a group with a third of all rows spreads over many tasks;
    what earlier partitions hold of a group comes from a table with a row for each (partition, group).
    Equal rows take their places in any order. Writes the sorted rows once.
    """
    keys = [*group, *order]
    cutted = cut(df.repartitionByRange(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()))
    local = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    part = cutted.withColumns({"_rank": F.row_number().over(local).cast("long"), **{f"_{c}": F.sum(c).over(local) for c in sums}})
    totals = cutted.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_rank"), *[F.sum(c).alias(f"_{c}") for c in sums])
    if group:
        ahead = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    else:
        ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    base = cut(totals.select("_part", *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
                             F.coalesce(F.sum("_rank").over(ahead), F.lit(0)).alias("_rank0"),
                             *[F.coalesce(F.sum(f"_{c}").over(ahead), F.lit(0)).alias(f"_{c}0") for c in sums]))
    same = part["_part"] == base["_part"]
    for i, g in enumerate(group):
        same = same & part[g].eqNullSafe(base[f"_g{i}"])
    return part.join(base, same).select(*[part[c] for c in df.columns], (part["_rank"] - 1 + base["_rank0"]).alias("rank"),
                                        *[(part[f"_{c}"] - part[c] + base[f"_{c}0"]).alias(f"{c}_before") for c in sums])
