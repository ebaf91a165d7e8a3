"""Nearest neighbours by an adaptive scan of dimensions.

Vectors are put in lists by their nearest centroid and rotated by a random orthogonal matrix, so that any block of columns is a
random sample of the distance. Within each probed list the candidates' partial distances grow block by block, and a hypothesis
test abandons those whose distance so far is too large, for their share of the columns, to be among the nearest. What is left is
measured on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut

#: Vectors, by the smallest hashes, that the centroids are trained on; every vector is put in a list.
TRAINED_ON = 20_000
#: Lists: the square root of the rows, at most so many.
MOST_LISTS = 1024
#: Recall within the training sample at which the number of probed lists is set, the sample rows asked for it, and the least
#: number of rows that probed lists must hold for each neighbour sought.
RECALL, ASKED, LEAST_ROWS = 0.98, 400, 20
#: Columns added between two tests, and the tests' width in standard deviations of a chi distribution's relative error.
COLUMNS, WIDTH = 16, 2.1
#: Rows of a list, and queries, in one group at most, as far as hashes deal them out evenly.
ROWS_AT_ONCE, QUERIES_AT_ONCE = 4096, 8192


def usable(vector: Column) -> Column:
    """Not null, not empty, without null or non-finite components, not zero."""
    good = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & good & F.exists(vector, lambda x: x != 0), F.lit(False))


def rotation(dim: int, seed: int = 17) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 17) -> np.ndarray:
    """Centroids of x; a centroid without rows moves to the row that is worst served."""
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near, d = nearest(x, c)
        sums, n = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        c[np.flatnonzero(n == 0)] = x[np.argsort(-d, kind="stable")[: int((n == 0).sum())]]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest row of c for each row of x, and its squared distance."""
    out, least = np.zeros(len(x), np.int64), np.zeros(len(x))
    for a in range(0, len(x), 4096):
        d = (c * c).sum(axis=1) - 2 * x[a: a + 4096] @ c.T
        out[a: a + 4096] = d.argmin(axis=1)
        least[a: a + 4096] = d.min(axis=1) + (x[a: a + 4096] ** 2).sum(axis=1)
    return out, least


def lists_needed(x: np.ndarray, c: np.ndarray, k: int, recall: float = RECALL) -> int:
    """So many of its nearest lists hold a row's k nearest neighbours with the given recall, as measured on the first rows of x.

    A sample is thinner than the table and its neighbours are farther off, so the number is rather too large than too small.
    """
    home, _ = nearest(x, c)
    ranks = [0]
    for i in range(min(ASKED, len(x))):
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        near = np.argpartition(d, min(k, len(x)) - 1)[:k] if len(x) > 1 else []
        place = np.empty(len(c), np.int64)
        place[np.argsort(((c - x[i]) ** 2).sum(axis=1), kind="stable")] = np.arange(len(c))
        ranks += [place[home[j]] for j in near if np.isfinite(d[j])]
    return int(np.quantile(ranks, recall, method="higher")) + 1


def scan(query: np.ndarray, rows: np.ndarray, k: int, slack: float, columns: int = COLUMNS, width: float = WIDTH) -> np.ndarray:
    """Places of the rows that may be among the k nearest to the query, all rotated.

    The first rows are measured whole and give a bound; from then on a row is dropped once its distance over d of D columns is above
    bound * d / D * (1 + width / sqrt(d)) ** 2. ``slack`` covers what rotation rounds.
    """
    dim, alive, bound = len(query), np.arange(len(rows)), np.inf
    head = min(len(rows), max(4 * k, 64))
    if head >= k:
        first = ((rows[:head] - query) ** 2).sum(axis=1)
        bound = float(np.partition(first, k - 1)[k - 1])
    part = np.zeros(len(rows))
    for a in range(0, dim, columns):
        z = min(a + columns, dim)
        part = part + ((rows[alive, a:z] - query[a:z]) ** 2).sum(axis=1)
        near = part <= (bound * (z / dim) * (1 + width / np.sqrt(z)) ** 2 if z < dim else bound) + slack
        alive, part = alive[near], part[near]
        if not len(alive):
            break
    if len(part) >= k:
        bound = min(bound, float(np.partition(part, k - 1)[k - 1]))
    return alive[part <= bound + slack]


def search(vectors: DataFrame, queries: Column, k: int = 10, row_id: str = "vec_id", vector: str = "embedding", recall: float = RECALL) -> DataFrame:
    """``query_id, rank`` (from 1), ``vec_id, score`` (Euclidean distance in double precision) of the k nearest vectors found for each query.

    Queries are the rows for which the condition holds; the candidates are all rows with another id. Ties go to the smaller id. Rows
    with a null id, or whose vector is null, empty, zero or holds null or non-finite components, take no part, nor do vectors
    of another length than most (of two lengths as frequent, the smaller). A row that comes twice is one candidate; of several rows with a query's id the smallest vector
    is searched. With fewer than k candidates all are returned; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    v = vectors[f"`{vector}`"].cast("array<double>")
    rows = vectors.select(vectors[f"`{row_id}`"].cast("long").alias("id"), v.alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).where(F.col("id").isNotNull() & usable(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    out = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], out)
    dim, total = lengths
    rows = rows.where(F.size("v") == dim)
    sample = rows.select("v", F.xxhash64("v", "id").alias("h")).orderBy("h", "v").limit(TRAINED_ON)
    trained = np.array([r["v"] for r in sample.select("v").collect()])
    centroids = kmeans(trained, max(1, min(MOST_LISTS, int(total**0.5))))
    least = lists_needed(trained, centroids, k, recall)
    turn = rotation(dim)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest(x, centroids)[0].astype(np.int32))], names=["id", "v", "asks", "list"])

    rows = cut(rows.mapInArrow(listed, "id long, v array<double>, asks boolean, list int"))
    counts = np.zeros(len(centroids), np.int64)
    for r in rows.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():  # at most MOST_LISTS rows
        counts[r["list"]] = r["n"]
    slices = np.maximum(1, -(-counts // ROWS_AT_ONCE))
    sought = cut(rows.where("asks").groupBy("id").agg(F.min("v").alias("v")))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            at, where, part = [], [], []
            for i in range(len(x)):
                order = np.argsort(((centroids - x[i]) ** 2).sum(axis=1), kind="stable")
                enough = int(np.searchsorted(np.cumsum(counts[order]), LEAST_ROWS * k)) + 1
                for c in order[: max(least, enough)]:
                    if counts[c]:
                        at += [i] * int(slices[c])
                        where += [int(c)] * int(slices[c])
                        part += range(int(slices[c]))
            taken = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(part, pa.int32()), batch.column("id").take(taken), batch.column("v").take(taken)],
                                             names=["list", "slice", "query_id", "q"])

    probes = sought.mapInArrow(asked, "list int, slice int, query_id long, q array<double>")
    turns = max(1, int(np.ceil(sought.count() * least / len(centroids) / QUERIES_AT_ONCE)))
    probes = probes.withColumn("turn", F.pmod(F.xxhash64("query_id"), F.lit(turns)).cast("int"))
    many = F.element_at(F.array(*[F.lit(int(s)) for s in slices]), F.col("list") + 1)
    held = rows.select("list", F.pmod(F.xxhash64("id"), many).cast("int").alias("slice"), "id", "v", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"))

    def found(asks: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        if not len(asks) or not len(have):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        have = have.loc[~pd.DataFrame({"id": have["id"], "v": have["v"].map(lambda a: np.asarray(a).tobytes())}).duplicated()].sort_values("id", kind="stable")
        ids, x = have["id"].to_numpy(np.int64), np.stack(have["v"].to_numpy())
        turned, norms = x @ turn, (x * x).sum(axis=1).max()
        repeated = len(ids) - len(np.unique(ids))
        parts = []
        for qid, q in zip(asks["query_id"], asks["q"]):
            q = np.asarray(q)
            near = scan(q @ turn, turned, k + repeated + int((ids == qid).sum()), 1e-12 * (norms + q @ q))
            near = near[ids[near] != qid]
            d = np.sqrt(((x[near] - q) ** 2).sum(axis=1))
            order = np.lexsort((ids[near], d))
            _, first = np.unique(ids[near][order], return_index=True)
            best = order[np.sort(first)[:k]]
            parts.append((np.full(len(best), qid), ids[near][best], d[best]))
        q, i, d = (np.concatenate(p) for p in zip(*parts))
        return pd.DataFrame({"query_id": q, "vec_id": i, "score": d})

    partial = probes.groupBy("list", "slice", "turn").cogroup(held.groupBy("list", "slice", "turn")).applyInPandas(found, "query_id long, vec_id long, score double")
    nearest_first = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = partial.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
