"""Shards of equal bytes by histogram sort.

The rows get a key that orders them by id, then by content, then by a place of their own. Splitters between shards, and between
the pieces that a shard is exchanged in, are found by counting: each round cuts every bracket that still holds a splitter into
equal cells, adds up the exact bytes of each cell over all partitions, and keeps the one cell in which the splitter lies, until the
bytes below it are within the tolerance. Then the rows are exchanged once, by piece; a row's slot is its place in the sorted piece
after the counts of the pieces before. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import beside, cut, partitions

#: Cells of a round, shared by the open brackets, and the fewest of a bracket; a round brings so many sums to the driver.
CELLS, FEWEST = 8192, 16
#: Bits of a key that order rows of one id by content, and rows of one content by place.
CONTENT, PLACE = 24, 37
DECIMAL = "decimal(38,0)"


def row_key(row_id: Column, text: Column, place: Column) -> Column:
    """Orders rows by id (null first), then by a hash of the text, then by a hash of the place; at most 126 bits, as a decimal."""
    content = F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(F.lit(2**CONTENT - 1))
    low = content * F.lit(2**PLACE) + F.xxhash64(place).bitwiseAND(F.lit(2**PLACE - 1))
    high = F.coalesce(row_id.cast(DECIMAL), F.lit(str(-(2**63) - 1)).cast(DECIMAL))
    return (high * F.lit(2 ** (CONTENT + PLACE)) + low.cast(DECIMAL)).cast(DECIMAL)


def _numbers(ns: list[int], kind: str = DECIMAL) -> Column:
    """A list of whole numbers as one constant."""
    return F.split(F.lit(",".join(map(str, ns))), ",").cast(f"array<{kind}>")


def count_below(bounds: list[int], k: Column) -> Column:
    """How many of the sorted bounds are at most ``k``: first among every n-th bound, then among the n that follow it."""
    if not bounds:
        return F.lit(0)
    n = math.isqrt(len(bounds)) + 1
    heads, every = _numbers(bounds[::n]), _numbers(bounds)
    group = F.size(F.filter(heads, lambda b: b <= k))
    within = F.size(F.filter(F.slice(every, F.greatest(F.lit(0), group - 1) * n + 1, F.lit(n)), lambda b: b <= k))
    return F.when(group == 0, 0).otherwise((group - 1) * n + within)


def splitters(keyed: DataFrame, shards: int, pieces: int = 1, tolerance: float = 0.001, key: str = "key", size: str = "size") -> list[int]:
    """``shards * pieces - 1`` keys; piece i takes the keys from splitter i - 1 on, below splitter i. No rows give no keys.

    The bytes below each splitter differ from their share of all bytes by at most ``tolerance`` of a shard and a tenth of a piece,
    unless a single key holds more.
    """
    bins = shards * pieces
    lo, hi, total = keyed.agg(F.min(key), F.max(key), F.sum(size)).first()  # one row
    if not total:
        return []
    lo, hi, total = int(lo), int(hi) + 1, int(total)
    goal = [total * i / bins for i in range(1, bins)]
    slack = total * min(tolerance / shards, 0.1 / bins)
    found: dict[int, int] = {}
    # brackets: (low, high, bytes below low) -> the splitters sought in it
    open_ = {(lo, hi, 0): list(range(bins - 1))} if bins > 1 else {}
    while open_:
        brackets = sorted(open_)
        cells = max(FEWEST, CELLS // len(brackets))
        steps = [-(-(z - a) // cells) for a, z, _ in brackets]
        k, b = F.col("k"), F.col("b")
        placed = keyed.select(F.col(key).alias("k"), F.col(size).alias("s"), (count_below([a for a, _, _ in brackets], F.col(key)) - 1).alias("b"))
        inside = F.when(k < F.get(_numbers([z for _, z, _ in brackets]), b), k - F.get(_numbers([a for a, _, _ in brackets]), b))
        placed = placed.select("k", "s", "b", inside.alias("above"), F.get(_numbers(steps), b).alias("step")).selectExpr("k", "s", "b", "above div step AS c")
        sums = placed.groupBy("b", "c").agg(F.sum("s").alias("bytes"), F.min("k").alias("least"), F.max("k").alias("most")).where("c IS NOT NULL").collect()
        by: dict[int, list] = {}
        for r in sums:
            by.setdefault(r["b"], []).append((int(r["least"]), int(r["most"]), int(r["bytes"])))
        following: dict[tuple[int, int, int], list[int]] = {}
        for b, bracket in enumerate(brackets):
            held_cells = sorted(by[b])
            at, below = 0, bracket[2]
            for i in open_[bracket]:  # ascending, as are the cells
                while at < len(held_cells) - 1 and below + held_cells[at][2] < goal[i]:
                    below += held_cells[at][2]
                    at += 1
                least, most, held = held_cells[at]
                before, after = abs(goal[i] - below), abs(below + held - goal[i])
                if before <= slack or least == most and before <= after:
                    found[i] = least
                elif after <= slack or least == most:
                    found[i] = most + 1
                else:
                    following.setdefault((least, most + 1, below), []).append(i)
        open_ = following
    return [found[i] for i in range(bins - 1)]


def shard_rows(docs: DataFrame, shards: int = 16, row_id: str = "doc_id", text: str = "text", size: Column | None = None,
               keep: list[Column] | None = None) -> DataFrame:
    """All rows as ``row`` with ``size``, ``shard`` (from 0) and ``slot`` (from 0 in each shard, without gaps).

    Size is the text's UTF-8 bytes plus 1 unless given. Shards hold nearly equal bytes and are ranges of the ids, so one after the
    other they are the sorted table. Null ids come first, null and empty texts have size 1, a very long text stays whole and may
    outweigh a shard; repeated rows are told apart by a place of their own, so that many of them spread over shards; an empty table
    gives no rows. ``keep`` are the columns that ``row`` carries through the exchange, all if not given.
    """
    t = docs[f"`{text}`"].cast("string")
    size = size if size is not None else F.coalesce(F.octet_length(t), F.lit(0)).cast("long") + 1
    placed = beside(docs, keep, id=docs[f"`{row_id}`"], t=t, size=size, place=F.monotonically_increasing_id())
    # written, since places must be the same whenever the rows are read
    df = cut(placed.select("row", "size", row_key(F.col("id"), F.col("t"), F.col("place")).alias("key")))
    # a piece for each half task, so that tasks that get several are still alike
    tasks = partitions(df.sparkSession)
    pieces = -(-2 * tasks // shards)
    bounds = splitters(df.select("key", "size"), shards, pieces)
    df = df.withColumn("piece", count_below(bounds, F.col("key")))
    counts = {r["piece"]: r["count"] for r in df.groupBy("piece").count().collect()}  # a row for each piece
    before = [sum(counts.get(p, 0) for p in range(i - i % pieces, i)) for i in range(shards * pieces)]
    ordered = Window.partitionBy("piece").orderBy("key")
    slot = F.row_number().over(ordered) - 1 + F.get(_numbers(before, "bigint"), F.col("piece"))
    return df.repartition(tasks, "piece").select("row", "size", F.expr(f"cast(piece div {pieces} AS int)").alias("shard"), slot.alias("slot"))
