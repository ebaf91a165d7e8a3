"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cleanloom.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, id long, v string, rank int"


def frame(spark, ids, vectors):
    return spark.createDataFrame([(i, v, None, None, "x", 1) for i, v in zip(ids, vectors)], SCHEMA).repartition(5)


def found(df):
    out = {}
    for r in neighbours.search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def brute(ids, x, q, k=10):
    d = np.sqrt(((x - x[list(ids).index(q)]) ** 2).sum(axis=1))
    keep = np.array([i != q for i in ids])
    order = np.lexsort((np.array(ids)[keep], d[keep]))[:k]
    return [(int(np.array(ids)[keep][i]), float(d[keep][i])) for i in order]


def test_recall_and_scores(spark):
    r = np.random.default_rng(2)
    x = (r.standard_normal((3000, 24)) + 3 * r.standard_normal((30, 24))[r.integers(0, 30, 3000)]).astype(np.float32).astype(np.float64)
    ids = list(range(3000))
    got, hit = found(frame(spark, ids, x.tolist())), 0
    assert sorted(got) == list(range(0, 3000, 100))
    for q, near in got.items():
        want = brute(ids, x, q)
        assert len(near) == 10 and near == sorted(near, key=lambda p: (p[1], p[0]))
        hit += len({i for i, _ in near} & {i for i, _ in want})
        for i, s in near:
            assert s == pytest.approx(np.sqrt(((x[i] - x[q]) ** 2).sum()), rel=1e-12)
    assert hit >= 0.9 * 300


def test_hot_vector_and_ties(spark):
    r = np.random.default_rng(4)
    x = r.standard_normal((2000, 8)).astype(np.float32).astype(np.float64)
    x[::3] = x[0]
    ids = list(range(2000))
    got = found(frame(spark, ids, x.tolist()))
    assert [i for i, _ in got[0]] == [3 * i for i in range(1, 11)] and all(s == 0 for _, s in got[0])
    assert [i for i, _ in got[300]] == [3 * i for i in range(10)]


def test_odd_vectors(spark):
    x = [[1.0, 2.0], [1.0, 2.5], None, [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [], [1.0, None], [1.0, 2.0, 3.0], [4.0, 4.0], [1.0, 2.5], [9.0, 9.0]]
    ids = [0, 1, 100, 200, 300, 400, 500, 600, 700, 2, 1, None]
    got = found(frame(spark, ids, x))
    assert got == {0: [(1, pytest.approx(0.5)), (2, pytest.approx(13**0.5))]}
    assert neighbours.search(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 100 == 0).count() == 0
    assert found(frame(spark, [0], [[1.0, 1.0]])) == {}


def test_scan_drops_only_far_rows():
    r = np.random.default_rng(6)
    x, turn = r.standard_normal((4000, 64)), neighbours.rotation(64)
    missed = kept = 0
    for q in r.standard_normal((20, 64)):
        near = neighbours.scan(q @ turn, x @ turn, 10, 1e-9)
        best = set(np.argsort(((x - q) ** 2).sum(axis=1))[:10].tolist())
        missed += len(best - set(near.tolist()))
        kept += len(near)
    assert missed <= 2 and kept < 20 * 100
