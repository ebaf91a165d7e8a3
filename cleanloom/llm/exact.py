"""Exact duplicates by an extendible-hash index on shared files.

Texts without white space are hashed to 64 bits. Equal texts become one entry by a grouping that compares their bytes and combines
copies before the shuffle, so that a text held by a third of all rows travels once for each task. The entries go into buckets of
hash prefixes: while a bucket is overfull the directory doubles, that is, the bucket's range of hashes is halved. Each bucket, a
range of keys, is the work of one owner task, which chains entries whose hashes collide. Records, entries and directory are
Parquet in the folder of the index; ``lookup`` asks it for other tables. DataFrame functions only.

An index folder holds ``records`` (one for each row: hash, text without white space, length, and the columns asked for),
``entries`` (one for each text, in its bucket) and ``directory`` (one row for each bucket: prefix, depth).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import beside, cut, shared_folder

#: Entries in a bucket.
CAPACITY = 1024
#: A text with more than this share of all rows is joined by broadcast: at most 1 / HOT such texts exist.
HOT = 0.001
#: Characters that do not count.
BLANK = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def squeezed(text: Column) -> Column:
    """The text without white space; empty for null."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    for c in BLANK:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def hashed(norm: Column, bits: int = 64) -> Column:
    """The first ``bits`` bits of a text's hash; fewer than 64 only in tests, to make hashes collide."""
    h = F.xxhash64(norm)
    return h if bits == 64 else F.shiftleft(F.shiftrightunsigned(h, 64 - bits), 64 - bits)


def prefix(h: Column, depth: int) -> Column:
    return F.shiftrightunsigned(h, 64 - depth) if depth else F.lit(0).cast("long")


def directory(hashes: DataFrame, capacity: int = CAPACITY, bits: int = 64) -> DataFrame:
    """``bucket`` (hash prefix), ``depth`` (its bits) and ``held`` of every bucket of distinct hashes ``h``.

    The first directory has the fewest slots that could hold all entries; then overfull buckets are split, and only their
    entries are counted again, until all fit. Buckets of the full hash take what is left.
    """
    total = hashes.count()
    depth = min(bits, max(0, math.ceil(math.log2(max(1, total) / capacity))))
    done, left = None, hashes
    while True:
        slots = cut(left.groupBy(prefix(F.col("h"), depth).alias("bucket")).agg(F.count(F.lit(1)).alias("held")).withColumn("depth", F.lit(depth)))
        full = F.col("held") > capacity if depth < bits else F.lit(False)
        done = slots.where(~full) if done is None else done.unionByName(slots.where(~full))
        over = slots.where(full).select(F.col("bucket").alias("b"))
        if over.isEmpty():
            return done
        left = cut(left.join(over, prefix(F.col("h"), depth) == F.col("b"), "left_semi"))
        depth += 1


def slots(buckets: DataFrame) -> tuple[DataFrame, int]:
    """The directory at its global depth: ``slot, bucket, depth``, and that depth."""
    deepest = buckets.agg(F.max("depth")).first()[0] or 0  # one row
    first = F.col("bucket") * F.pow(F.lit(2.0), deepest - F.col("depth")).cast("long")
    return buckets.select(F.explode(F.sequence(first, first + F.pow(F.lit(2.0), deepest - F.col("depth")).cast("long") - 1)).alias("slot"), "bucket", "depth"), deepest


def build(docs: DataFrame, folder: str | None = None, row_id: str = "doc_id", text: str = "text", keep: list[Column] | None = None,
          capacity: int = CAPACITY, bits: int = 64) -> str:
    """Writes the index of all rows and returns its folder.

    The row that stays of equal texts has the most code points in its original text, then the smallest id (null last), then comes
    first in the table as it is read. ``keep`` are the columns that the records hold, all if not given.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark)
    t = docs[f"`{text}`"].cast("string")
    read = beside(docs, keep, id=docs[f"`{row_id}`"], chars=F.coalesce(F.length(t), F.lit(0)), norm=squeezed(t), uid=F.monotonically_increasing_id())
    records = cut(read.withColumn("h", hashed(F.col("norm"), bits)), f"{folder}/records")
    best = F.min(F.struct((-F.col("chars")).alias("chars"), F.col("id").isNull().alias("none"), "id", "uid")).alias("best")
    entries = cut(records.groupBy("h", "norm").agg(best, F.count(F.lit(1)).alias("n")).select(
        "h", F.sha2(F.col("norm").cast("binary"), 256).alias("sha256"), F.col("best.id").alias("keep_id"), F.col("best.uid").alias("keep_uid"), "n"))
    buckets = cut(directory(entries.select("h").distinct(), capacity, bits), f"{folder}/directory")
    where, deepest = slots(buckets)
    placed = entries.withColumn("slot", prefix(F.col("h"), deepest)).join(where, "slot").drop("slot")
    same = Window.partitionBy("bucket", "h")
    owned = placed.repartition("bucket").withColumns({"chain": F.row_number().over(same.orderBy("sha256", "keep_uid")), "chain_size": F.count(F.lit(1)).over(same)})
    cut(owned, f"{folder}/entries")
    return folder


def read_index(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records, entries and directory of an index."""
    return tuple(spark.read.parquet(f"{folder}/{part}") for part in ("records", "entries", "directory"))


def _with_text(entries: DataFrame, records: DataFrame) -> DataFrame:
    """Entries with their texts, which the records hold."""
    return entries.join(records.select(F.col("uid").alias("keep_uid"), "norm"), "keep_uid")


def exact_dedup(docs: DataFrame, row_id: str = "doc_id", text: str = "text", keep: list[Column] | None = None, folder: str | None = None,
                capacity: int = CAPACITY, bits: int = 64) -> DataFrame:
    """All rows as ``row`` with ``keep_id, group_size, kept, text_sha256`` of the rows with an equal text.

    Texts are equal when their characters other than white space are; null and blank texts equal the empty one. One row of each
    group stays, also of rows that are the same in every column (see ``build``). Very long texts are compared whole, an empty
    table gives no rows, and columns of any name may come in ``row``.
    """
    records, entries, _ = read_index(docs.sparkSession, build(docs, folder, row_id, text, keep, capacity, bits))
    found = ["keep_id", F.col("n").alias("group_size"), (F.col("uid") == F.col("keep_uid")).alias("kept"), F.col("sha256").alias("text_sha256")]
    rows = records.select("row", "uid", "h")
    many = entries.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * HOT  # one row
    alone = entries.where("chain_size = 1").select("h", "keep_id", "keep_uid", "n", "sha256")
    hot = F.broadcast(alone.where(F.col("n") > many))  # at most 1 / HOT rows
    others = rows.join(hot.select("h"), "h", "left_anti").join(alone.where(F.col("n") <= many), "h")
    out = rows.join(hot, "h").select("row", *found).unionByName(others.select("row", *found))
    chained = entries.where("chain_size > 1")
    if chained.isEmpty():
        return out
    texts = _with_text(chained.select("h", "keep_id", "keep_uid", "n", "sha256"), records)
    return out.unionByName(records.select("row", "uid", "h", "norm").join(texts, ["h", "norm"]).select("row", *found))


def drop_copies(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with the columns of ``docs``; nulls, blanks, repeats and empty tables as in ``exact_dedup``."""
    return exact_dedup(docs, row_id, text).where("kept").select("row.*")


def lookup(docs: DataFrame, folder: str, text: str = "text", bits: int = 64) -> DataFrame:
    """All rows as ``row`` with ``keep_id`` and ``known``: whether the index holds their text, by hash, bucket and bytes.

    Null and blank texts are the empty text. An empty table, or an empty index, gives no rows or no known ones.
    """
    records, entries, buckets = read_index(docs.sparkSession, folder)
    where, deepest = slots(buckets)
    asked = beside(docs, None, norm=squeezed(docs[f"`{text}`"]), uid=F.monotonically_increasing_id())
    asked = cut(asked.withColumn("h", hashed(F.col("norm"), bits)).withColumn("slot", prefix(hashed(F.col("norm"), bits), deepest)))
    sought = asked.select("h", "slot").distinct().join(where.select("slot", "bucket"), "slot").select("bucket", "h")
    texts = _with_text(entries.join(sought, ["bucket", "h"], "left_semi").select("h", "keep_id", "keep_uid"), records)
    # distinct texts first, so that a text asked for by many rows is compared once
    met = asked.select("h", "norm").distinct().join(texts, ["h", "norm"]).select("h", "norm", "keep_id", F.lit(True).alias("known"))
    return asked.join(met, ["h", "norm"], "left").select("row", "keep_id", F.coalesce("known", F.lit(False)).alias("known"))
