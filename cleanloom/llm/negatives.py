"""Hard negatives by rotated one-bit codes.

Vectors are integers: floor(256 * x) of each component. A random rotation spreads each one evenly over its components; the code
keeps their signs only, and beside it the length of the vector along its code. What a code leaves over is coded again in the same
way, LEVELS times. The inner product of a query with a code comes from counts of common bits with the query's bit planes. Of a
residual r, which is orthogonal to its code, Cauchy and Schwarz say that |<r, q>| <= |r| * |q - (q along the code)|, so each score
lies in an interval that no chance enters. Rows whose interval cannot matter are passed over; the others are scored in integers.

Anchors are compared with all rows, in groups of a block of anchors and a block of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut

#: One-bit codes of a row, each of what the one before leaves over.
LEVELS = 5
#: Bits to which a rotated query is rounded for the counts; the rounding widens the interval.
PLANES = 9
#: Rows and anchors of a block, as far as hashes deal them out evenly, and anchors taken at once within a block.
ROWS_AT_ONCE, ANCHORS_AT_ONCE, TOGETHER = 8192, 65536, 64
#: Components beyond this are not taken: with at most 2**20 components a score fits into 63 bits.
LARGEST = 2**21


def rotation(dim: int, seed: int = 29) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    pad = -bits.shape[1] % 64
    return np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1).view(np.uint64)


def encode(v: np.ndarray, turn: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, levels, words), and lengths along each code and of the last residual (rows, levels + 1)."""
    rest = v.astype(np.float64) @ turn
    codes, along = [], []
    for _ in range(levels):
        up = rest >= 0
        sign = np.where(up, 1.0, -1.0) / np.sqrt(v.shape[1])
        a = (rest * sign).sum(axis=1)
        rest = rest - a[:, None] * sign
        codes.append(packed(up))
        along.append(a)
    return np.stack(codes, axis=1), np.stack([*along, np.sqrt((rest * rest).sum(axis=1))], axis=1)


class Query:
    """Rotated anchors, rounded to bit planes."""

    def __init__(self, v: np.ndarray, turn: np.ndarray):
        self.dim = v.shape[1]
        x = v.astype(np.float64) @ turn
        self.square = (x * x).sum(axis=1)
        self.low = x.min(axis=1) if len(x) else np.zeros(0)
        self.step = np.maximum((x.max(axis=1) - self.low) / (2**PLANES - 1), 1e-9) if len(x) else np.zeros(0)
        u = np.rint((x - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        self.total = u.sum(axis=1)
        self.planes = [packed((u >> p) & 1 == 1) for p in range(PLANES)]
        # what rounding leaves is known exactly, so its length bounds its product with a code (of length 1)
        left = x - (self.low[:, None] + self.step[:, None] * u)
        self.left = np.sqrt((left * left).sum(axis=1))

    def along(self, i: slice, code: np.ndarray, ones: np.ndarray) -> np.ndarray:
        """Inner products of anchors ``i`` with codes of length 1, up to ``left``."""
        common = np.zeros((len(self.low[i]), len(code)), np.int64)
        for p, plane in enumerate(self.planes):
            for w in range(code.shape[1]):
                common += np.bitwise_count(plane[i, w, None] & code[None, :, w]).astype(np.int64) << p
        return (self.low[i, None] * (2 * ones - self.dim)[None, :] + self.step[i, None] * (2 * common - self.total[i, None])) / np.sqrt(self.dim)

    def interval(self, i: slice, codes: np.ndarray, ones: np.ndarray, along: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score that each pair of an anchor and a row can have."""
        mid, wide, levels = 0.0, 0.0, codes.shape[1]
        for level in range(levels):
            p = self.along(i, codes[:, level], ones[:, level])
            mid = mid + p * along[None, :, level]
            wide = wide + self.left[i, None] * np.abs(along[None, :, level])
        inside = np.maximum(np.abs(p) - self.left[i, None], 0)
        wide = wide + along[None, :, levels] * np.sqrt(np.maximum(self.square[i, None] - inside * inside, 0))
        lengths = np.sqrt((along * along).sum(axis=1))
        slack = 1e-9 * (1 + np.sqrt(self.square[i])[:, None] * lengths[None, :])  # of floating point
        return mid - wide - slack, mid + wide + slack


def matrix(column: pa.ChunkedArray | pa.Array, kind: type, shape: tuple[int, ...]) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), *shape)


def scored(anchors: np.ndarray, rows: np.ndarray, a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Integer inner products of pairs (a[i], r[i])."""
    out = np.empty(len(a), np.int64)
    for at in range(0, len(a), 65536):
        out[at: at + 65536] = np.einsum("ij,ij->i", anchors[a[at: at + 65536]], rows[r[at: at + 65536]])
    return out


def kth(values: np.ndarray, where: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest value in each row among those marked; minus infinity where there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(np.where(where, values, -np.inf), -k, axis=1)[:, -k]


def first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each group, higher scores first, then smaller ids."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    start = np.r_[0, np.flatnonzero(g[1:] != g[:-1]) + 1] if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(start, np.diff(np.r_[start, len(g)]))
    return order[rank < k]


class Block:
    """Rows of one block and their codes."""

    def __init__(self, table: pa.Table, dim: int, turn: np.ndarray):
        words = -(-dim // 64)
        self.ids = table["id"].to_numpy().astype(np.int64)
        self.labels = table["label"].to_numpy().astype(np.int64)
        self.v = matrix(table["v"], np.int32, (dim,)).astype(np.int64)
        self.turn = turn
        if "codes" in table.column_names:
            self.codes = matrix(table["codes"], np.uint64, (LEVELS, words))
            self.along = matrix(table["along"], np.float64, (LEVELS + 1,))
            self.ones = np.bitwise_count(self.codes).sum(axis=2).astype(np.int64)

    def __len__(self) -> int:
        return len(self.ids)


def positives_in(anchors: Block, rows: Block, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of anchors and rows, and scores, of the first k rows of the block with each anchor's label."""
    query, out = Query(anchors.v, rows.turn), []
    for at in range(0, len(anchors), TOGETHER):
        i = slice(at, at + TOGETHER)
        low, high = query.interval(i, rows.codes, rows.ones, rows.along)
        same = (anchors.labels[i, None] == rows.labels[None, :]) & (anchors.ids[i, None] != rows.ids[None, :])
        a, r = np.nonzero(same & (high >= kth(low, same, k)[:, None]))
        score = scored(anchors.v[i], rows.v, a, r)
        best = first(a, score, rows.ids[r], k)
        out.append((a[best] + at, r[best], score[best]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def negatives_in(anchors: Block, rows: Block, pairs: list[list[tuple[int, int]]], k: int, least: int, most: int) -> tuple[np.ndarray, ...]:
    """Anchor places, positive ids and scores, row places and scores of the first k fitting rows of another label, for each positive of each anchor."""
    query, out = Query(anchors.v, rows.turn), []
    for at in range(0, len(anchors), TOGETHER):
        i = slice(at, at + TOGETHER)
        low, high = query.interval(i, rows.codes, rows.ones, rows.along)
        other = anchors.labels[i, None] != rows.labels[None, :]
        mine = pairs[at: at + TOGETHER]
        for turn in range(max((len(p) for p in mine), default=0)):
            have = np.array([len(p) > turn for p in mine])
            pid = np.array([p[turn][0] if len(p) > turn else 0 for p in mine], np.int64)
            ps = np.array([p[turn][1] if len(p) > turn else 0 for p in mine], np.int64)
            floor, ceiling = ps * least / 100, ps * most / 100
            may = other & have[:, None] & (high >= floor[:, None] - 1) & (low <= ceiling[:, None] + 1)
            sure = may & (low >= floor[:, None] + 1) & (high <= ceiling[:, None] - 1)
            a, r = np.nonzero(may & (high >= kth(low, sure, k)[:, None]))
            score = scored(anchors.v[i], rows.v, a, r)
            fits = (least * ps[a] <= 100 * score) & (100 * score <= most * ps[a])
            a, r, score = a[fits], r[fits], score[fits]
            best = first(a, score, rows.ids[r], k)
            out.append((a[best] + at, pid[a[best]], ps[a[best]], r[best], score[best]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 5


def prepared(vectors: DataFrame, label: Column, row_id: str, vector: str) -> DataFrame:
    """``id, label, v`` (integers) of the rows that take part, one for each id."""
    x = vectors[f"`{vector}`"].cast("array<double>")
    good = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & ~F.exists(x, lambda c: F.abs(c) >= LARGEST / 256)
    rows = vectors.select(vectors[f"`{row_id}`"].cast("long").alias("id"), label.cast("long").alias("label"), x.alias("x")).where(
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(good & (F.size("x") > 0), F.lit(False)))
    ints = rows.select("id", F.struct("label", F.transform("x", lambda c: F.floor(c * 256).cast("int")).alias("v")).alias("r"))
    return ints.groupBy("id").agg(F.min("r").alias("r")).select("id", "r.*")


def hard_negatives(vectors: DataFrame, anchors: Column, label: Column, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90,
                   row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of the hard negatives of each anchor's positives.

    A row's score is its integer inner product with the anchor. Positives are the anchor's first other rows of its label, negatives
    the first rows of another label with ``least * positive <= 100 * negative <= most * positive``; higher scores come first, ties by
    smaller id. ``anchors`` is a condition on the columns of ``vectors``; ids and labels are integers. Rows with a null id, label or
    vector, an empty vector, a null or non-finite component or one of 8192 or more in size take no part, nor do vectors of another
    length than most (of two lengths as frequent, the smaller). Of rows with one id the one with the smallest label, then the
    smallest vector counts. An anchor without positives, or a positive without negatives, gives no rows, as does an empty table.
    """
    spark = vectors.sparkSession
    names = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    asked = vectors.where(F.coalesce(anchors, F.lit(False))).select(vectors[f"`{row_id}`"].cast("long").alias("id")).where("id IS NOT NULL").distinct()
    ints = cut(prepared(vectors, label, row_id, vector))
    lengths = ints.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    if lengths is None:
        return spark.createDataFrame([], names)
    dim, total = lengths
    turn = rotation(dim)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(-1, dim)
            codes, along = encode(v, turn)
            data = [pa.array([x.tobytes() for x in part], pa.binary()) for part in (v, codes, along)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), *data], names=["id", "label", "v", "codes", "along"])

    blocks = max(1, -(-total // ROWS_AT_ONCE))
    rows = cut(ints.where(F.size("v") == dim).mapInArrow(coded, "id long, label long, v binary, codes binary, along binary"))
    chosen = cut(rows.join(asked, "id", "left_semi").select("id", "label", "v"))
    turns = max(1, -(-chosen.count() // ANCHORS_AT_ONCE))
    part = F.pmod(F.xxhash64("id"), F.lit(turns)).cast("int").alias("turn")
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    block = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(blocks)).cast("int").alias("block")
    # each anchor meets each block of rows; a block of rows is copied once for every ANCHORS_AT_ONCE anchors
    held = rows.select(block, F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"), "id", "label", "v", "codes", "along").groupBy("block", "turn")

    def nearest(asks: pa.Table, have: pa.Table) -> pa.Table:
        a, r = Block(asks, dim, turn), Block(have, dim, turn)
        i, j, score = positives_in(a, r, positives)
        return pa.table({"anchor_id": a.ids[i], "positive_id": r.ids[j], "positive_score": score})

    met = chosen.select(everywhere, part, "id", "label", "v").groupBy("block", "turn").cogroup(held).applyInArrow(nearest, "anchor_id long, positive_id long, positive_score long")
    in_order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    best = met.withColumn("rank", F.row_number().over(in_order)).where(F.col("rank") <= positives)
    pairs = best.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("pairs"))  # as many as positives asked for
    armed = cut(chosen.join(pairs, chosen["id"] == pairs["anchor_id"]).select("id", "label", "v", "pairs"))

    def hardest(asks: pa.Table, have: pa.Table) -> pa.Table:
        a, r = Block(asks, dim, turn), Block(have, dim, turn)
        mine = [[(p["positive_id"], p["positive_score"]) for p in x] for x in asks["pairs"].to_pylist()]
        i, pid, ps, j, score = negatives_in(a, r, mine, negatives, least, most)
        return pa.table({"anchor_id": a.ids[i], "positive_id": pid, "positive_score": ps, "negative_id": r.ids[j], "negative_score": score})

    found = armed.select(everywhere, part, "id", "label", "v", "pairs").groupBy("block", "turn").cogroup(held).applyInArrow(
        hardest, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    in_order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(in_order)).where(F.col("rank") <= negatives).select(*(x.split()[0] for x in names.split(", ")))
