"""Ordered operations that hold up without a partition key and with hot groups.

A plain window moves each group to one task: all rows when there is no group,
a third of them when one group is hot. Here the rows are cut into *chunks*,
ranges of (group, order key), by bounds taken from a sample of the keys:

1. ``chunked``: one count and one bounded key sample give the bounds; the chunk
   number is an ordinary CASE expression over the key columns, so it is the
   same on every evaluation and after the loss of an executor;
2. the operator runs as a window inside (group, chunk);
3. ``carry``: one partially aggregated pass gives a row per (group, chunk); the
   running value of the earlier chunks of the same group is joined back. Only
   groups cut by a bound need it: at most one per bound, so that table is at
   most as long as the bound list and is broadcast.

Below ``cleanloom.scan.rowsPerChunk`` counted rows there is one chunk, which is
the plain window. Above ``cleanloom.scan.literalChunks`` chunks the bounds are those
of a range exchange, and the rows are written with their chunk number.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Mapping, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F, types as T

from .core import OpError, as_list, col, need, q, tmp_name

ROWS_PER_CHUNK = 10_000
ROWS_PER_TASK = 2_000_000
LITERAL_CHUNKS = 4096
SAMPLE_PER_CHUNK = 32
BROADCAST_BYTES = 4_000_000
_FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


@dataclass(frozen=True)
class Key:
    """One order key."""

    name: str
    asc: bool = True
    nulls_first: bool = False

    def column(self) -> Column:
        c = col(self.name)
        if self.asc:
            return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()
        return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()

    def flipped(self) -> "Key":
        return Key(self.name, not self.asc, not self.nulls_first)


def keys_of(order_by, nulls_first: bool = False) -> list[Key]:
    """Order keys from names, ``-name`` for descending, or (name, ascending) pairs."""
    out = []
    for item in as_list(order_by):
        if isinstance(item, Key):
            out.append(item)
        elif isinstance(item, str):
            out.append(Key(item[1:], False, nulls_first) if item.startswith("-") else Key(item, True, nulls_first))
        else:
            out.append(Key(item[0], bool(item[1]), nulls_first))
    return out


def need_order(df: DataFrame, order_by) -> list[Key]:
    keys = keys_of(order_by)
    if not keys:
        raise OpError("order_by is required: a table has no row order of its own")
    need(df, [k.name for k in keys])
    return keys


def _conf(df: DataFrame, name: str, default: int) -> int:
    return int(df.sparkSession.conf.get(f"cleanloom.scan.{name}", str(default)))


def chunk_target(df: DataFrame, rows: int) -> int:
    """How many chunks to cut: one per 10 000 rows, but no more than 4 per shuffle partition
    unless a chunk would pass two million rows."""
    most = max(4 * shuffle_partitions(df), 64, math.ceil(rows / ROWS_PER_TASK))
    return max(1, min(most, math.ceil(rows / _conf(df, "rowsPerChunk", ROWS_PER_CHUNK))))


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _literal(value, type_name: str) -> str:
    if isinstance(value, bool):
        value = "true" if value else "false"
    body = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"CAST('{body}' AS {type_name})"


def _after(key: Key, value, type_name: str) -> tuple[str, str]:
    """SQL tests (key sorts after value, key equals value)."""
    c = q(key.name)
    if value is None:
        return (f"{c} IS NOT NULL" if key.nulls_first else "false"), f"{c} IS NULL"
    lit = _literal(value, type_name)
    later = f"{c} {'>' if key.asc else '<'} {lit}"
    later = f"coalesce({later}, false)" if key.nulls_first else f"coalesce({later}, true)"
    return later, f"coalesce({c} = {lit}, false)"


def _at_or_after(keys: Sequence[Key], bound: Sequence, types: Sequence[str]) -> str:
    later, equal = _after(keys[0], bound[0], types[0])
    if len(bound) == 1:
        return f"({later} OR {equal})"
    return f"({later} OR ({equal} AND {_at_or_after(keys[1:], bound[1:], types[1:])}))"


def later_than(df: DataFrame, keys: Sequence[Key], bound: Sequence) -> Column:
    """Whether a row sorts after the one whose keys, as text, are given."""
    types = [df.schema[k.name].dataType.simpleString() for k in keys]
    test = "false"
    for key, value, kind in reversed(list(zip(keys, bound, types))):
        later, equal = _after(key, value, kind)
        test = f"({later} OR ({equal} AND {test}))"
    return F.expr(test)


def _lookup(tests: Sequence[str], lo: int, hi: int) -> str:
    """Nested CASE that finds the chunk in log2(n) comparisons."""
    if lo == hi:
        return str(lo)
    mid = (lo + hi) // 2
    return f"if({tests[mid]}, {_lookup(tests, mid + 1, hi)}, {_lookup(tests, lo, mid)})"


def _bounds(df: DataFrame, keys: Sequence[Key], rows: int, chunks: int) -> list[tuple]:
    """Bounds between chunks of about equal weight.

    Each bound keeps only as many leading keys as tell it from the bound before,
    so a long key list matters only inside a hot prefix. Any sample gives right
    results: the bounds are literals of the plan from here on.
    """
    names = [col(k.name) for k in keys]
    share = min(1.0, chunks * SAMPLE_PER_CHUNK / max(rows, 1))
    sample = (
        df.select(*names).sample(withReplacement=False, fraction=share, seed=17)
        .groupBy(*names).agg(F.count(F.lit(1)).alias("__w"))
        .orderBy(*[k.column() for k in keys])
        .select(*[n.cast("string").alias(f"k{i}") for i, n in enumerate(names)], "__w")
        .collect()  # about SAMPLE_PER_CHUNK rows per chunk, whatever the table size
    )
    step = sum(r["__w"] for r in sample) / chunks
    bounds: list[tuple] = []
    seen, last = 0, None
    for row in sample:
        key = tuple(row)[:-1]
        if last is None:
            last = key
        elif seen >= step * (len(bounds) + 1) and key != last:
            depth = next(i for i in range(len(key)) if key[i] != last[i])
            bounds.append(key[: depth + 1])
            last = key
        seen += row["__w"]
    return bounds


@dataclass
class Chunked:
    """A frame with its chunk column, group columns and order keys."""

    df: DataFrame
    part: list[str]
    keys: list[Key]
    chunk: str
    chunks: int
    rows: int

    def window(self, reverse: bool = False) -> WindowSpec:
        keys = [k.flipped() for k in self.keys] if reverse else self.keys
        return Window.partitionBy(*[col(c) for c in self.part], col(self.chunk)).orderBy(*[k.column() for k in keys])

    def group_window(self, reverse: bool = False) -> WindowSpec:
        """Over the one-row-per-(group, chunk) summary."""
        by = [col(c) for c in self.part] or [F.lit(0)]
        chunk = col(self.chunk)
        return Window.partitionBy(*by).orderBy(chunk.desc() if reverse else chunk.asc())

    def spread(self) -> DataFrame:
        """The rows on their way into a chunk window. With more chunks than shuffle partitions the
        exchange gets a partition per chunk, so that a task sorts about one chunk."""
        if self.chunks <= shuffle_partitions(self.df):
            return self.df
        return self.df.repartition(self.chunks, *[col(c) for c in self.part], col(self.chunk))

    def summary(self, **aggs: Column) -> DataFrame:
        """One partially aggregated row per (group, chunk)."""
        return self.df.groupBy(*[col(c) for c in self.part], col(self.chunk)).agg(
            *[a.alias(n) for n, a in aggs.items()]
        )

    def carry(self, aggs: Mapping[str, Column], folds: Mapping[str, object], reverse: bool = False) -> DataFrame:
        """Value of each fold over the group's earlier chunks (later ones when ``reverse``).

        ``aggs`` build the per-chunk summary; ``folds`` map an output name to a
        function of (column, window) giving the exclusive running value.
        """
        w = self.group_window(reverse)
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        s = self.summary(**aggs).withColumn("__nth", F.row_number().over(w))
        s = s.select(
            *[col(c) for c in self.part], col(self.chunk), "__nth",
            *[fold(before).alias(n) for n, fold in folds.items()],
        )
        return s.where("__nth > 1").drop("__nth")

    def with_carry(self, out: DataFrame, carry: DataFrame, width: int = 1) -> DataFrame:
        """Join the carried values on; rows of a group's first chunk get null.

        The carry has at most one row per bound, each of up to ``width`` cells. It is broadcast where
        all its cells are of fixed width and their bytes are within ``BROADCAST_BYTES``; with text, lists or
        more rows Spark chooses the join.
        """
        keys = {c: f"__c{i}" for i, c in enumerate([*self.part, self.chunk])}
        right = carry.withColumnsRenamed(keys)
        fixed = all(isinstance(f.dataType, _FIXED) for f in right.schema.fields)
        if fixed and 16 * self.chunks * max(width, len(right.columns)) <= BROADCAST_BYTES:
            right = F.broadcast(right)
        cond = None
        for c, r in keys.items():
            test = out[q(c)].eqNullSafe(right[r])
            cond = test if cond is None else cond & test
        return out.join(right, cond, "left").drop(*keys.values())


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage before a frame is read several times.

    An ordered operator reads its input up to four times, so a chain of them would
    repeat the first steps many times over. With a shared folder named in
    ``spark.checkpoint.dir`` the frame is checkpointed there; without one it is
    returned as it is, and only the work repeats.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return df.checkpoint() if folder else df


def written(df: DataFrame) -> DataFrame:
    """The frame as a table in the folder all executors share: the checkpoint folder, else the warehouse."""
    conf = df.sparkSession.conf
    base = conf.get("spark.checkpoint.dir", None) or conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    folder = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


#: The cuts of a plan's order so far: (groups, keys, types) -> (rows, bounds).
_CUTS: ContextVar[dict | None] = ContextVar("cuts", default=None)


@contextmanager
def one_cut():
    """Within it, ordered steps of one group and order share the count and the bounds of the first one.

    Bounds only balance the chunks: any bounds give right results. So they may be kept as long as the rows stay about as they
    are; ``forget_cuts`` ends that.
    """
    token = _CUTS.set({})
    try:
        yield
    finally:
        _CUTS.reset(token)


def forget_cuts(columns: Iterable[str] | None = None) -> None:
    """Forget all cuts, or those by one of the columns."""
    cuts = _CUTS.get()
    if cuts:
        gone = set(columns or ())
        for cut in list(cuts):
            if columns is None or gone & {*cut[0], *(k.name for k in cut[1])}:
                del cuts[cut]


def chunked(df: DataFrame, part=None, order_by=None, rows: int | None = None) -> Chunked:
    """Cut the rows into ranges of (group, order key). Runs a count and a key sample, unless the order is cut already (``one_cut``)."""
    part = as_list(part)
    need(df, part)
    keys = need_order(df, order_by)
    cuts = _CUTS.get()
    mark = (tuple(part), tuple(keys), tuple(df.schema[c].dataType.simpleString() for c in [*part, *(k.name for k in keys)]))
    known = cuts.get(mark) if cuts is not None else None
    rows = known[0] if known else df.count() if rows is None else rows
    chunks = chunk_target(df, rows)
    name = tmp_name(df, "chunk")
    if chunks == 1:
        if cuts is not None:
            cuts[mark] = rows, []
        return Chunked(df.withColumn(name, F.lit(0)), part, keys, name, 1, rows)
    work, full = df, keys
    group = tmp_name(df, "group")
    if part:
        # A hash stands for the group: cheap to compare, and a collision only puts
        # two groups in one range, which the (group, chunk) window tells apart.
        work = df.withColumn(group, F.xxhash64(*[col(c) for c in part]))
        full = [Key(group, True, True), *keys]
    if chunks > _conf(df, "literalChunks", LITERAL_CHUNKS):
        # too many bounds for an expression: Spark deals the rows out by range, and the number of the range is written with them
        dealt = work.repartitionByRange(chunks, *[k.column() for k in full]).withColumn(name, F.spark_partition_id()).drop(group)
        return Chunked(written(dealt), part, keys, name, chunks, rows)
    bounds = known[1] if known else _bounds(work, full, rows, chunks)
    if cuts is not None:
        cuts[mark] = rows, bounds
    types = [work.schema[k.name].dataType.simpleString() for k in full]
    tests = [_at_or_after(full, b, types) for b in bounds]
    out = work.withColumn(name, F.expr(_lookup(tests, 0, len(tests))))
    return Chunked(out.drop(group), part, keys, name, len(tests) + 1, rows)


def running(df: DataFrame, part, order_by, aggs: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """Inclusive running aggregates per group in row order.

    ``aggs`` maps a new column to (kind, value): sum, count, min, max, product.
    Null values do not count and do not stop the run.
    """
    c = chunked(df, part, order_by)
    out = c.spread()
    frame = c.window().rowsBetween(Window.unboundedPreceding, 0)
    local = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "product": F.product}
    for name, (kind, value) in aggs.items():
        out = out.withColumn(name, local[kind](value).over(frame))
    if c.chunks == 1:
        return out.drop(c.chunk)
    fold = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max, "product": F.product}
    names = {name: f"__p{i}" for i, name in enumerate(aggs)}
    carry = c.carry(
        {f"__s{i}": local[kind](value) for i, (kind, value) in enumerate(aggs.values())},
        {names[n]: (lambda w, i=i, k=k: fold[k](f"__s{i}").over(w)) for i, (n, (k, _)) in enumerate(aggs.items())},
    )
    out = c.with_carry(out, carry, len(names))
    for name, (kind, _) in aggs.items():
        here, prev = col(name), col(names[name])
        both = {
            "sum": here + prev, "count": here + prev, "product": here * prev,
            "min": F.least(here, prev), "max": F.greatest(here, prev),
        }[kind]
        out = out.withColumn(name, F.coalesce(both, here, prev))
    return out.drop(c.chunk, *names.values())


def number(df: DataFrame, part, order_by, name: str, rows: int | None = None) -> DataFrame:
    """1-based position of each row in its group, as bigint."""
    c = chunked(df, part, order_by, rows)
    out = c.spread().withColumn(name, F.row_number().over(c.window()).cast("bigint"))
    if c.chunks == 1:
        return out.drop(c.chunk)
    carry = c.carry({"__n": F.count(F.lit(1))}, {"__p": lambda w: F.sum("__n").over(w)})
    out = c.with_carry(out, carry)
    return out.withColumn(name, col(name) + F.coalesce(col("__p"), F.lit(0))).drop(c.chunk, "__p")


def last_known(df: DataFrame, part, order_by, columns: Mapping[str, str], forward: bool = True) -> DataFrame:
    """Last non-null value up to and including each row (next one when not ``forward``).

    ``columns`` maps a source column to the name of the result.
    """
    c = chunked(df, part, order_by)
    return fill_on(c, c.spread(), columns, forward).drop(c.chunk)


def fill_on(c: Chunked, out: DataFrame, columns: Mapping[str, str], forward: bool) -> DataFrame:
    """``last_known`` on a frame that is cut already; ``out`` is ``c.spread()``, maybe with more columns."""
    frame = c.window(reverse=not forward).rowsBetween(Window.unboundedPreceding, 0)
    out = out.select("*", *[F.last(col(s), ignorenulls=True).over(frame).alias(f"__l{i}") for i, s in enumerate(columns)])
    if c.chunks > 1:
        out = c.with_carry(out, _last_carry(c, list(columns), forward), len(columns))
        out = out.withColumns({f"__l{i}": F.coalesce(f"__l{i}", f"__e{i}") for i in range(len(columns))})
        out = out.drop(*[f"__e{i}" for i in range(len(columns))])
    out = out.withColumns({target: col(f"__l{i}") for i, target in enumerate(columns.values())})
    return out.drop(*[f"__l{i}" for i in range(len(columns))])


def _last_carry(c: Chunked, columns: Sequence[str], forward: bool) -> DataFrame:
    if not _packable(c):
        return _edge_values(c, columns, forward)
    at = F.struct(*[_sort_value(c.df, k) for k in c.keys])
    by = F.max_by if forward else F.min_by
    known = lambda s: col(s).isNotNull()
    return c.carry(
        {f"__v{i}": by(F.when(known(s), F.struct(col(s).alias("v"))), F.when(known(s), at)) for i, s in enumerate(columns)},
        {f"__e{i}": (lambda w, i=i: F.last(f"__v{i}", ignorenulls=True).over(w)["v"]) for i in range(len(columns))},
        reverse=not forward)


def _packable(c: Chunked) -> bool:
    from pyspark.sql import types as T

    ok = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)
    return all(k.asc or isinstance(c.df.schema[k.name].dataType, ok) for k in c.keys)


def _sort_value(df: DataFrame, key: Key) -> Column:
    """A struct that compares ascending in the key's order."""
    from pyspark.sql import types as T

    c = col(key.name)
    kind = df.schema[key.name].dataType
    flag = F.when(c.isNull(), 0 if key.nulls_first else 2).otherwise(1)
    if not key.asc:
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            c = -F.unix_micros(c.cast("timestamp"))
        elif isinstance(kind, T.DateType):
            c = -F.unix_date(c)
        elif isinstance(kind, T.BooleanType):
            c = -c.cast("int")
        elif isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = -c
        else:
            c = -c.cast("decimal(20,0)")
    return F.struct(flag.alias("f"), c.alias("v"))


def _edge_values(c: Chunked, columns: Sequence[str], forward: bool) -> DataFrame:
    """Carry of the last non-null value per chunk when the keys do not fit one struct."""
    full = c.window(reverse=not forward).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = c.df.select(
        *[col(p) for p in c.part], col(c.chunk),
        F.row_number().over(c.window()).alias("__rn"),
        *[F.struct(F.last(col(s), ignorenulls=True).over(full).alias("v")).alias(f"__v{i}") for i, s in enumerate(columns)],
    ).where("__rn = 1").drop("__rn")
    w = c.group_window(reverse=not forward)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    s = rows.withColumn("__nth", F.row_number().over(w)).select(
        *[col(p) for p in c.part], col(c.chunk), "__nth",
        *[F.last(F.when(F.col(f"__v{i}")["v"].isNotNull(), F.col(f"__v{i}")), ignorenulls=True).over(before)["v"].alias(f"__e{i}")
          for i in range(len(columns))],
    )
    return s.where("__nth > 1").drop("__nth")


#: Rows of a window, a shift or a limit up to which a chunk takes what it needs of its neighbours as lists.
NEAR = 256


def _far(df: DataFrame, part, order_by) -> tuple[DataFrame, list[str], str]:
    """The rows with their place in their group, written, for steps that look far away; groups, and the name of the place."""
    at = tmp_name(df, "at")
    return settle(number(df, part, order_by, at)), as_list(part), at


def far_shifted(df: DataFrame, part, order_by, columns: Mapping[str, str], offset: int, edge_default=None) -> DataFrame:
    """``shifted`` for any distance: each row is joined with the row at the place it looks at."""
    rows, part, at = _far(df, part, order_by)
    cell = F.struct(*[col(s).alias(f"v{i}") for i, s in enumerate(columns)]).alias("__x")
    other = rows.select(*[col(p).alias(f"__p{i}") for i, p in enumerate(part)], (col(at) + offset).alias("__to"), cell)
    same = col(at) == F.col("__to")
    for i, p in enumerate(part):
        same = same & col(p).eqNullSafe(F.col(f"__p{i}"))
    out = rows.join(other, same, "left")
    new = {}
    for i, (source, target) in enumerate(columns.items()):
        value = F.col(f"__x.v{i}")
        new[target] = value if edge_default is None else F.when(F.col("__x").isNull(), F.lit(edge_default).cast(df.schema[source].dataType)).otherwise(value)
    return out.withColumns(new).drop("__x", "__to", at, *[f"__p{i}" for i in range(len(part))])


def far_sums(df: DataFrame, part, order_by, value: Column, before: int, after: int, total: str, count: str) -> DataFrame:
    """``moving_sums`` for windows of any length, in time and memory that grow with the rows alone.

    Stretches at least as long as the window take a copy of the rows next to them; within each, sums over windows are differences of
    running sums. Values that are not finite are counted apart, as they would spoil all later differences.
    """
    rows, part, at = _far(df.withColumn("__v", value.cast("double")), part, order_by)
    length = max(ROWS_PER_CHUNK, before, after, 1)
    place, home = col(at) - 1, F.floor((col(at) - 1) / length)
    near = [home]
    if before:
        near.append(F.when(place % length >= length - before, home + 1))
    if after:
        near.append(F.when((place % length < after) & (home > 0), home - 1))
    copies = rows.withColumn("__home", home).withColumn("__to", F.explode(F.array_compact(F.array(*near))))
    w = Window.partitionBy(*[col(p) for p in part], "__to").orderBy(col(at))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    v = F.col("__v")
    wild = F.isnan(v) | (F.abs(v) == float("inf"))
    parts = {"s": F.when(v.isNotNull() & ~wild, v), "c": F.when(v.isNotNull(), 1), "n": F.when(F.isnan(v), 1), "p": F.when(v == float("inf"), 1), "m": F.when(v == float("-inf"), 1)}
    kinds = {k: "double" if k == "s" else "bigint" for k in parts}
    out = copies.select("*", *[F.coalesce(F.sum(x).over(upto), F.lit(0)).cast(kinds[k]).alias(f"__{k}") for k, x in parts.items()])
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def within(k: str) -> Column:
        last = F.coalesce(F.lead(f"__{k}", after).over(w), F.last(f"__{k}").over(whole)) if after else F.col(f"__{k}")
        return last - F.coalesce(F.lag(f"__{k}", before + 1).over(w), F.lit(0).cast(kinds[k]))

    out = out.select("*", *[within(k).alias(f"__w{k}") for k in parts]).where("__to = __home")
    spoiled = F.when((F.col("__wn") > 0) | ((F.col("__wp") > 0) & (F.col("__wm") > 0)), float("nan")).when(F.col("__wp") > 0, float("inf")).when(F.col("__wm") > 0, float("-inf"))
    out = out.withColumns({count: F.col("__wc"), total: F.when(F.col("__wc") > 0, F.coalesce(spoiled, F.col("__ws")))})
    return out.drop("__v", "__home", "__to", at, *[f"__{k}" for k in parts], *[f"__w{k}" for k in parts])


def far_known(df: DataFrame, part, order_by, columns: Mapping[str, str], limit: int, forward: bool = True) -> DataFrame:
    """``last_within`` for any limit: the last known value comes with its place, which must not be too far."""
    rows, part, at = _far(df, part, order_by)
    seen = {f"__f{i}": F.when(col(s).isNotNull(), F.struct(col(at).alias("at"), col(s).alias("v"))) for i, s in enumerate(columns)}
    keys = [Key(at)]
    out = last_known(rows.withColumns(seen), part, keys, {f: f for f in seen}, forward)
    near = lambda f: F.abs(col(at) - F.col(f)["at"]) <= limit
    return out.withColumns({t: F.when(near(f), F.col(f)["v"]) for f, t in zip(seen, columns.values())}).drop(at, *seen)


def with_edges(c: Chunked, out: DataFrame, cells: Column, before: int, after: int) -> DataFrame:
    """Add what a row near a chunk edge needs of the neighbouring chunks.

    ``out`` must carry ``__rn`` (place in the chunk) and, for ``after``, ``__rr``
    (place from its end). Adds ``__b``, the up to ``before`` last cells ahead of
    the chunk, and ``__a``, the up to ``after`` first cells behind it.
    """
    for size, name, forward in ((before, "__b", True), (after, "__a", False)):
        if size and c.chunks > 1:
            out = c.with_carry(out, _edges(c, cells, size, forward), size)
    return out


def _edges(c: Chunked, cells: Column, size: int, forward: bool) -> DataFrame:
    """Per (group, chunk): the ``size`` nearest cells of the chunks before (or after), in row order.

    Spark pushes the ``row_number <= size`` limit below the shuffle, and only
    groups cut by a bound keep a row, so the result is bounded by the bound list.
    """
    by = [*[col(p) for p in c.part], col(c.chunk)]
    near = (
        c.df.select(*by, cells.alias("__cell"), F.row_number().over(c.window(reverse=forward)).alias("__d"))
        .where(F.col("__d") <= size)
        .groupBy(*by)
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("__d") if forward else F.col("__d")).alias("d"), "__cell"))).alias("__e"))
    )
    w = c.group_window(reverse=not forward)
    lists = F.collect_list("__e").over(w.rowsBetween(-size, -1))
    s = near.withColumn("__nth", F.row_number().over(w))
    s = s.withColumn("__all", F.flatten(lists if forward else F.reverse(lists))).where("__nth > 1")
    flat = F.transform("__all", lambda x: x["__cell"])
    if forward:
        cut = F.when(F.size(flat) > size, F.slice(flat, F.size(flat) - size + 1, size)).otherwise(flat)
    else:
        cut = F.slice(flat, 1, size)
    return s.select(*by, cut.alias("__b" if forward else "__a"))


def shifted(df: DataFrame, part, order_by, columns: Mapping[str, str], offset: int, edge_default=None) -> DataFrame:
    """Values ``offset`` rows back (negative: ahead); ``edge_default`` only past the group's edge."""
    if abs(offset) > NEAR:
        return far_shifted(df, part, order_by, columns, offset, edge_default)
    c = chunked(df, part, order_by)
    n = abs(offset)
    back = offset >= 0
    cell = F.struct(*[col(s).alias(f"v{i}") for i, s in enumerate(columns)])
    w = c.window(reverse=not back)
    out = c.spread().select("*", F.lag(cell, n).over(w).alias("__x") if n else cell.alias("__x"), F.row_number().over(w).alias("__rn"))
    if n and c.chunks > 1:
        out = with_edges(c, out, cell, n if back else 0, 0 if back else n)
        if back:
            other = F.get("__b", F.size("__b") - (F.lit(n) - F.col("__rn") + 1))
        else:
            other = F.get("__a", F.lit(n) - F.col("__rn"))
        out = out.withColumn("__x", F.when(F.col("__rn") > n, F.col("__x")).otherwise(other))
    new = {}
    for i, (source, target) in enumerate(columns.items()):
        value = F.col(f"__x.v{i}")
        if edge_default is not None:
            value = F.when(F.col("__x").isNull(), F.lit(edge_default).cast(df.schema[source].dataType)).otherwise(value)
        new[target] = value
    return out.withColumns(new).drop("__x", "__rn", "__b", "__a", c.chunk)


def moving_sums(df: DataFrame, part, order_by, value: Column, before: int, after: int, total: str, count: str) -> DataFrame:
    """Sum and non-null count over the rows from ``before`` back to ``after`` ahead."""
    if max(before, after) > NEAR:
        return far_sums(df, part, order_by, value, before, after, total, count)
    c = chunked(df, part, order_by)
    w = c.window()
    frame = w.rowsBetween(-before, after)
    out = c.spread().select(
        "*", F.sum(value).over(frame).alias(total), F.count(value).over(frame).alias(count),
        F.row_number().over(w).alias("__rn"), F.row_number().over(c.window(reverse=True)).alias("__rr"),
    )
    if c.chunks > 1:
        out = with_edges(c, out, F.struct(value.alias("v")), before, after)
        for size, name, place in ((before, "__b", F.col("__rn")), (after, "__a", F.col("__rr"))):
            if not size:
                continue
            lack = F.least(F.lit(size) - (place - 1), F.size(name))
            start = F.size(name) - lack + 1 if name == "__b" else F.lit(1)
            cells = F.when((lack > 0) & F.col(name).isNotNull(), F.filter(F.slice(name, start, lack), lambda x: x["v"].isNotNull()))
            extra = F.when(F.size(cells) > 0, F.aggregate(cells, F.lit(0.0), lambda a, x: a + x["v"].cast("double")))
            out = out.withColumn(total, F.coalesce(F.col(total) + extra, F.col(total), extra))
            out = out.withColumn(count, F.col(count) + F.when(F.size(cells) > 0, F.size(cells)).otherwise(0))
    return out.drop("__rn", "__rr", "__b", "__a", c.chunk)


def _field_known(name: str):
    return lambda x: x[name].isNotNull()


def last_within(df: DataFrame, part, order_by, columns: Mapping[str, str], limit: int, forward: bool = True) -> DataFrame:
    """Last non-null value among the row and the ``limit`` rows before it (after it when not ``forward``)."""
    if limit > NEAR:
        return far_known(df, part, order_by, columns, limit, forward)
    c = chunked(df, part, order_by)
    w = c.window(reverse=not forward)
    cell = F.struct(*[col(s).alias(f"v{i}") for i, s in enumerate(columns)])
    local = [F.last(col(s), ignorenulls=True).over(w.rowsBetween(-limit, 0)).alias(f"__x{i}") for i, s in enumerate(columns)]
    out = c.spread().select("*", *local, F.row_number().over(w).alias("__rn"))
    if c.chunks > 1:
        out = with_edges(c, out, cell, limit if forward else 0, 0 if forward else limit)
        side = "__b" if forward else "__a"
        lack = F.least(F.lit(limit) - (F.col("__rn") - 1), F.size(side))
        start = F.size(side) - lack + 1 if forward else F.lit(1)
        near = F.when((lack > 0) & F.col(side).isNotNull(), F.slice(side, start, lack))
        found = {}
        for i in range(len(columns)):
            known = F.filter(near, _field_known(f"v{i}"))
            found[f"__x{i}"] = F.coalesce(f"__x{i}", F.try_element_at(known, F.lit(-1 if forward else 1))[f"v{i}"])
        out = out.withColumns(found)
    out = out.withColumns({target: F.col(f"__x{i}") for i, target in enumerate(columns.values())})
    return out.drop(*[f"__x{i}" for i in range(len(columns))], "__rn", "__b", "__a", c.chunk)
