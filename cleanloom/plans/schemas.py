"""Schemas of many tables as one relation, checked against a relation of expectations.

``schemas`` has a row for each column: (table, position, column, type_class, nullable, rows, nulls). It comes from the footers of
Parquet files, which tasks read without the data, or from frames. ``expected`` has (table, position, column, type_class, nullable,
extra_ok); all but table and column may be null, which asks for nothing. Every check is a join by (table, column); renamed columns
are proposed through an inverted index of what their names have in common.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.core import rows_frame, type_class
from ..functions.similarity import rename_score
from ..sources import blocks

SCHEMA = "table string, position int, column string, type_class string, nullable boolean, rows long, nulls long"
DRIFT = ("table", "kind", "column", "expected", "observed")


def _arrow_class(kind: pa.DataType) -> str:
    t = pa.types
    if t.is_integer(kind):
        return "integer"
    if t.is_floating(kind) or t.is_decimal(kind):
        return "float"
    if t.is_boolean(kind):
        return "boolean"
    return "datetime" if t.is_date(kind) or t.is_timestamp(kind) else "string"


def parquet_schemas(spark: SparkSession, paths, table: Column | None = None) -> DataFrame:
    """The schemas of all tables under the paths, from their files' footers; the files' rows and nulls are added up.

    A file's table is the folder or file name that ends in ``.parquet``, or what ``table`` makes of the column ``file``. Nulls are
    null where a file states none, as for columns of lists.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for batch in batches:
            out = []
            for uri in batch.column("file").to_pylist():
                with blocks._open(uri) as f:
                    meta = pq.ParquetFile(f).metadata
                stated: dict[str, int | None] = {}
                for g in range(meta.num_row_groups):
                    for i in range(meta.num_columns):
                        c = meta.row_group(g).column(i)
                        n = c.statistics.null_count if c.is_stats_set and c.statistics.has_null_count else None
                        top = c.path_in_schema.split(".")[0]
                        old = stated.get(top, 0)
                        stated[top] = None if n is None or old is None or c.path_in_schema != top else old + n
                for i, field in enumerate(meta.schema.to_arrow_schema()):
                    out.append((uri, i, field.name, _arrow_class(field.type), field.nullable, meta.num_rows, stated.get(field.name, 0)))
            columns = list(zip(*out)) or [()] * 7
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "position", "column", "type_class", "nullable", "rows", "nulls"])

    files = blocks.listing(spark, paths).mapInArrow(read, "file string, position int, column string, type_class string, nullable boolean, rows long, nulls long")
    name = F.regexp_extract("file", r"([^/]+)\.parquet(?:/|$)", 1) if table is None else table
    known = F.when(F.count("nulls") == F.count(F.lit(1)), F.sum("nulls"))
    return files.groupBy(name.alias("table"), "column").agg(
        F.min("position").alias("position"), F.max("type_class").alias("type_class"), F.bool_or("nullable").alias("nullable"), F.sum("rows").alias("rows"), known.alias("nulls")
    ).select(*[x.split()[0] for x in SCHEMA.split(", ")])


def frame_schemas(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The schemas of frames; rows and nulls are not counted."""
    spark = next(iter(tables.values())).sparkSession
    return rows_frame(spark, [(t, i, f.name, type_class(f.dataType), f.nullable, None, None) for t, df in tables.items() for i, f in enumerate(df.schema.fields)], SCHEMA)


def _folded(df: DataFrame, case_sensitive: bool, side: str) -> DataFrame:
    key = F.col("column") if case_sensitive else F.lower("column")
    return df.select(F.col("table").alias("t"), key.alias("k"), F.struct(*df.columns).alias(side))


def _joined(schemas: DataFrame, expected: DataFrame, case_sensitive: bool) -> DataFrame:
    return _folded(schemas, case_sensitive, "have").join(_folded(expected, case_sensitive, "want"), ["t", "k"], "full")


def drift(schemas: DataFrame, expected: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """(table, kind, column, expected, observed): ``missing`` and ``extra`` columns, other ``type`` classes and ``nullable`` columns that
    hold nulls where none are allowed. One join over all tables; no row for a table is no drift."""
    d = _joined(schemas, expected, case_sensitive)
    have, want = F.col("have"), F.col("want")
    strict = expected.groupBy(F.col("table").alias("t")).agg(F.bool_or(~F.coalesce("extra_ok", F.lit(False))).alias("strict"))
    d = d.join(strict, "t", "left")

    def row(test: Column, kind: str, column: Column, wanted: Column, seen: Column) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(kind).alias("kind"), column.alias("column"), wanted.cast("string").alias("expected"), seen.cast("string").alias("observed")))

    both = have.isNotNull() & want.isNotNull()
    none = F.lit(None)
    found = F.array(
        row(have.isNull(), "missing", want["column"], want["column"], none),
        row(want.isNull() & F.col("strict"), "extra", have["column"], none, have["column"]),
        row(both & (have["type_class"] != want["type_class"]), "type", have["column"], want["type_class"], have["type_class"]),
        row(both & ~want["nullable"] & (have["nulls"] > 0), "nullable", have["column"], F.lit("no nulls"), F.concat(have["nulls"], F.lit(" nulls"))))
    return d.select(F.col("t").alias("table"), F.inline(F.array_compact(found))).select(*DRIFT)


def renames(schemas: DataFrame, expected: DataFrame, threshold: float = 0.6, case_sensitive: bool = False) -> DataFrame:
    """(table, expected, observed, name_similarity, confidence, observed_type): for each missing column the most similar extra one of
    its table, if it is at least ``threshold`` similar; of equals the first one.

    An index holds the names' characters by place, their pairs of characters and words, and their single characters where the names
    are so short that one may make up enough of the other; only pairs that share an entry are scored. Above 0.3 no other pair
    can reach the threshold.
    """
    if threshold <= 0.3:
        raise ValueError("threshold must be above 0.3: below, names with nothing in common would do")
    d = _joined(schemas, expected, case_sensitive)
    short = F.lit(int(1 / (threshold - 0.2)) if threshold > 0.2 else 64)

    def entries(name: Column) -> Column:
        n = F.lower(name)
        at = F.transform(F.sequence(F.lit(1), F.length(n)), lambda i: F.concat(F.lit("@"), i, F.lit(":"), n.substr(i, F.lit(1))))
        pairs = F.when(F.length(n) > 1, F.transform(F.sequence(F.lit(1), F.length(n) - 1), lambda i: F.concat(F.lit("2:"), n.substr(i, F.lit(2))))).otherwise(F.array().cast("array<string>"))
        single = F.when(F.length(n) <= short, F.transform(F.split(n, ""), lambda c: F.concat(F.lit("1:"), c))).otherwise(F.array().cast("array<string>"))
        words = F.transform(F.split(n, r"[_\s]"), lambda w: F.concat(F.lit("w:"), w))
        return F.explode(F.array_distinct(F.concat(at, pairs, single, words)))

    gone = d.where("have IS NULL").select("t", F.col("want.column").alias("expected"))
    new = d.where("want IS NULL").select("t", F.col("have.column").alias("observed"), F.col("have.position").alias("position"), F.col("have.type_class").alias("observed_type"))
    left = gone.where("expected <> ''").select("t", "expected", entries(F.col("expected")).alias("e"))
    right = new.where("observed <> ''").select("t", "observed", "position", "observed_type", entries(F.col("observed")).alias("e"))
    pairs = left.join(right, ["t", "e"]).select("t", "expected", "observed", "position", "observed_type").distinct()
    score = rename_score(F.lower("expected"), F.lower("observed"))
    scored = pairs.withColumn("score", score).where(F.col("score") >= threshold)
    best = scored.groupBy("t", "expected").agg(F.max_by(F.struct("observed", "score", "observed_type"), F.struct("score", (-F.col("position")).alias("p"))).alias("b"))
    s = F.col("b.score")
    return best.select(F.col("t").alias("table"), "expected", F.col("b.observed").alias("observed"), F.bround(s, 3).alias("name_similarity"),
                       F.when(s > 0.8, "high").when(s > 0.6, "medium").otherwise("low").alias("confidence"), F.col("b.observed_type").alias("observed_type"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(table, kind, column, expected, observed): columns that went or came between two states of the tables, and classes of types
    that changed, but for integers that became floats."""
    out = drift(after, before.select("table", "position", "column", "type_class", F.lit(None).cast("boolean").alias("nullable"), F.lit(False).alias("extra_ok")), True)
    return out.where(~((F.col("kind") == "type") & (F.col("expected") == "integer") & (F.col("observed") == "float")))
