"""Ordered operators cut into many chunks against pandas, with a hot group and null cells."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cleanloom.functions import quantiles, scan
from cleanloom.operators import calculate as K, columns as C, groups as G, quality as V, rows as R


@pytest.fixture(scope="module")
def frame(spark):
    rnd = random.Random(5)
    data = []
    for i in range(240):
        g = "hot" if i % 3 == 0 else rnd.choice(["a", "b", None, "c%d" % (i % 40)])  # one group holds a third of the rows
        v = None if rnd.random() < 0.4 else float(rnd.randint(1, 20))
        data.append((i * 7 % 241, g, v, "t%02d" % rnd.randint(0, 30)))
    pdf = pd.DataFrame(data, columns=["k", "g", "v", "s"])
    return spark.createDataFrame(data, "k int, g string, v double, s string"), pdf.sort_values("k").reset_index(drop=True)


def col(df, name):
    out = df.orderBy("k").select(name).toPandas()[name]
    return [None if pd.isna(x) else (round(float(x), 6) if isinstance(x, (int, float, np.number)) else x) for x in out]


def want(s):
    return [None if pd.isna(x) else (round(float(x), 6) if not isinstance(x, str) else x) for x in s]


def test_bounds_cut_the_hot_group(frame, chunks):
    df, _ = frame
    c = scan.chunked(df, ["g"], ["k"])
    per = c.df.groupBy("g").agg(F.count_distinct(c.chunk).alias("n")).where("g = 'hot'").first()["n"]
    assert c.chunks > 10 and per > 5


def test_row_numbers(frame, chunks):
    df, pdf = frame
    assert col(R.row_number(df, "n", 1, order_by=["k"]), "n") == want(pd.Series(range(1, 241)))
    pdf = pdf.assign(g=pdf.g.fillna("~"))
    assert col(R.row_number(df, "n", 1, ["g"], order_by=["k"]), "n") == want(pdf.groupby("g").cumcount() + 1)


def test_row_number_by_text_descending_with_nulls(frame, chunks):
    df, pdf = frame
    order = pdf.sort_values(["g", "s", "k"], ascending=[False, True, False], na_position="last").reset_index(drop=True)
    expected = order.assign(n=range(1, 241)).sort_values("k").n
    assert col(R.row_number(df, "n", 1, order_by=["-g", "s", "-k"]), "n") == want(expected)


def test_running_values(frame, chunks):
    df, pdf = frame
    assert col(K.running_total(df, "v", "t", order_by=["k"]), "t") == want(pdf.v.cumsum())
    assert col(K.running_total(df, "v", "t", "g", order_by=["k"]), "t") == want(pdf.groupby("g").v.cumsum())
    for fn, pandas_fn in (("max", "cummax"), ("min", "cummin")):
        assert col(K.cumulative(df, ["v"], fn, "g", "_c", order_by=["k"]), "v_c") == want(getattr(pdf.groupby("g").v, pandas_fn)())


@pytest.mark.parametrize("group", [None, "g"])
def test_fills(frame, chunks, group):
    df, pdf = frame
    source = pdf.groupby("g").v if group else pdf.v
    assert col(C.fill_forward(df, ["v"], None, group, order_by=["k"]), "v") == want(source.ffill())
    assert col(C.fill_backward(df, ["v"], None, group, order_by=["k"]), "v") == want(source.bfill())
    assert col(C.fill_forward(df, ["v"], 1, group, order_by=["k"]), "v") == want(source.ffill(limit=1))
    assert col(C.fill_backward(df, ["v"], 2, group, order_by=["k"]), "v") == want(source.bfill(limit=2))


def test_fill_by_descending_text(frame, chunks):
    df, pdf = frame
    order = pdf.sort_values(["s", "k"], ascending=[False, True])
    assert col(C.fill_forward(df, ["v"], order_by=["-s", "k"]), "v") == want(order.v.ffill().sort_index())


@pytest.mark.parametrize("n", [1, 3, 12])
def test_shifts_longer_than_a_chunk(frame, chunks, n):
    df, pdf = frame
    assert col(K.lag(df, "v", "x", n, order_by=["k"]), "x") == want(pdf.v.shift(n))
    assert col(K.lead(df, "v", "x", n, None, "g", order_by=["k"]), "x") == want(pdf.groupby("g").v.shift(-n))
    filled = K.lag_lead(df, ["v"], n, None, "_s", -1.0, order_by=["k"])
    assert col(filled, "v_s") == want(pdf.v.shift(n).where(pdf.index >= n, -1.0))


@pytest.mark.parametrize("window,center", [(3, False), (4, True), (25, False)])
def test_moving_average(frame, chunks, window, center):
    df, pdf = frame
    got = col(K.moving_average(df, "v", window, "m", 2, center, order_by=["k"]), "m")
    assert got == want(pdf.v.rolling(window, min_periods=2, center=center).mean())
    got = col(K.moving_average(df, "v", window, "m", 1, center, "g", order_by=["k"]), "m")
    ok = pdf.g.notna()
    expected = pdf.groupby("g").v.transform(lambda s: s.rolling(window, min_periods=1, center=center).mean())
    assert got == want(expected.where(ok))


@pytest.mark.parametrize("method", ["dense", "min", "max", "average"])
def test_ranks(frame, chunks, method):
    df, pdf = frame
    assert col(K.rank(df, "v", "r", True, method), "r") == want(pdf.v.rank(method=method))
    assert col(K.rank(df, "v", "r", False, method, "g"), "r") == want(pdf.groupby("g").v.rank(method=method, ascending=False))


def test_percent_rank_and_ntile(frame, chunks):
    df, pdf = frame
    assert col(K.percent_rank(df, "v", "r"), "r") == want(pdf.v.rank(method="min") / pdf.v.count())
    got = K.ntile(df.limit(10), 4, "k", "b").groupBy("b").count().orderBy("b").toPandas()["count"].tolist()
    assert got == [3, 2, 3, 2]
    got = K.ntile(df.limit(10), 4, "k", "b", sql=True).groupBy("b").count().orderBy("b").toPandas()["count"].tolist()
    assert got == [3, 3, 2, 2]


def test_interpolate(frame, chunks):
    df, pdf = frame
    assert col(R.interpolate(df, "v", ["k"]), "v") == want(pdf.v.interpolate())


def test_lineage_is_cut_in_the_shared_folder(frame, chunks):
    df, _ = frame
    out = scan.settle(R.row_number(df, "n", order_by=["k"]))
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == 240


def test_duplicate_flags(frame, chunks):
    df, pdf = frame
    for keep in ("first", "last", "none"):
        got = V.is_duplicate(df, ["g", "v"], keep, "d", order_by=["k"]).orderBy("k").toPandas().d.tolist()
        assert got == pdf.duplicated(["g", "v"], keep=False if keep == "none" else keep).tolist()


def test_concat_in_row_order(frame, chunks):
    df, pdf = frame
    got = {r["g"]: r["s"] for r in R.merge_duplicates(df, "g", {"s": "concat"}, order_by=["k"]).collect()}
    assert got == pdf.dropna(subset="g").groupby("g").s.agg(", ".join).to_dict()


@pytest.mark.parametrize("small", [0, 10_000])
def test_exact_quantiles(spark, frame, chunks, small):
    df, pdf = frame
    spark.conf.set("cleanloom.quantile.smallRows", str(small))
    try:
        row = quantiles.quantiles(df, [], "v", [0.0, 0.25, 0.5, 0.9, 1.0]).first()
        assert np.allclose(list(row), pdf.v.quantile([0.0, 0.25, 0.5, 0.9, 1.0]))
        got = {r["g"]: r["q0"] for r in quantiles.quantiles(df, ["g"], "v", [0.5]).collect()}
        expected = pdf.groupby("g").v.median()
        assert all(np.isclose(got[g], m) for g, m in expected.items() if not np.isnan(m))
    finally:
        spark.conf.unset("cleanloom.quantile.smallRows")


def test_identical_rows_do_not_break_the_cut(spark, chunks):
    df = spark.range(60).select((F.col("id") % 2).alias("x"))
    assert R.row_number(df, "n", order_by=["x"]).agg(F.sum("n")).first()[0] == 60 * 61 // 2


def test_few_distinct_keys_are_still_cut(spark, chunks):
    df = spark.range(4000).select((F.col("id") % 20).alias("day"), F.col("id"))
    c = scan.chunked(df, [], ["day"])
    assert 10 <= c.chunks <= 20 and c.df.select("day", c.chunk).distinct().count() == 20


def test_offset_and_large_limit(spark, frame, chunks, monkeypatch):
    df, pdf = frame
    assert sorted(r["k"] for r in R.offset_rows(df, 100, ["k"]).collect()) == pdf.k.tolist()[100:]
    monkeypatch.setattr(R, "HEAP_ROWS", 5)
    assert [r["k"] for r in R.head_rows(df, 50, ["k"]).collect()] == pdf.k.tolist()[:50]
    assert [r["k"] for r in R.tail_rows(df, 50, ["k"]).collect()] == pdf.k.tolist()[-50:]
    assert R.sample_rows(df, 60, seed=1, key=["k"]).count() == 60


def test_chunks_beyond_the_literal_bounds(spark):
    """Bounds by a range exchange give the same numbers and sums as one window."""
    rows = [(i, "hot" if i % 3 else f"g{i % 4}", float(i % 11)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, g string, x double")
    spark.conf.set("cleanloom.scan.rowsPerChunk", "10")
    spark.conf.set("cleanloom.scan.literalChunks", "3")
    try:
        c = scan.chunked(df, ["g"], ["id"])
        assert c.chunks == 6
        got = {r["id"]: (r["n"], r["s"]) for r in scan.running(df, ["g"], ["id"], {"n": ("count", F.col("x")), "s": ("sum", F.col("x"))}).collect()}
    finally:
        spark.conf.unset("cleanloom.scan.literalChunks")
        spark.conf.unset("cleanloom.scan.rowsPerChunk")
    seen = {}
    for i, g, x in rows:
        n, s = seen.get(g, (0, 0.0))
        seen[g] = (n + 1, s + x)
        assert got[i] == seen[g]


@pytest.mark.parametrize("part", [[], ["g"]])
def test_far_windows_shifts_and_fills(frame, monkeypatch, part):
    df, _ = frame
    df = df.withColumn("v", F.when(F.col("k") == 50, float("nan")).when(F.col("k") == 90, float("inf")).otherwise(F.col("v")))
    near = {}
    for far in (False, True):
        monkeypatch.setattr(scan, "NEAR", 0 if far else 10_000)
        monkeypatch.setattr(scan, "ROWS_PER_CHUNK", 20)  # many stretches
        out = df
        for i, (before, after) in enumerate(((3, 4), (0, 30), (500, 0))):
            out = scan.settle(scan.moving_sums(out, part, ["k"], F.col("v"), before, after, f"sum{i}", f"cnt{i}"))
        for i, n in enumerate((5, -9)):
            out = scan.settle(scan.shifted(out, part, ["k"], {"s": f"shift{i}"}, n, "none" if i else None))
        for i, (limit, forward) in enumerate(((2, True), (4, False))):
            out = scan.settle(scan.last_within(out, part, ["k"], {"v": f"known{i}"}, limit, forward))
        near[far] = out.orderBy("k").toPandas()
    for c in near[False].columns:
        assert want(near[False][c]) == want(near[True][c]), c


def test_value_functions_of_many_columns(spark):
    rnd = random.Random(3)
    data = [(rnd.choice(["a", "b", "hot", "hot", None]), rnd.choice([1, 2, 3, None]), rnd.choice([1.5, 2.5, 9.0, None]), rnd.choice(["10", "9", "x", None]), None) for _ in range(400)]
    df = spark.createDataFrame(data, "g string, i int, x double, s string, e double")
    wanted = [("i", "median", "m"), ("i", "mode", "o"), ("x", "quantile:0.9", "q"), ("s", "mode", "so"), ("s", "nunique", "u"), ("e", "median", "em"), ("e", "nunique", "eu"), ("x", "sum", "t")]
    apart = {}
    for by in (["g"], []):
        got = R.aggregate_columns(df, by, wanted)
        for c, f, n in wanted:
            one = R.aggregate_columns(df, by, [(c, f, n)])
            apart[n] = sorted(map(tuple, one.collect()), key=str)
            assert sorted(map(tuple, got.select(*by, n).collect()), key=str) == apart[n], (by, n)
            assert one.schema[n].dataType == got.schema[n].dataType, n


def test_concat_parts(spark):
    df = spark.range(3000).selectExpr("IF(id % 3 > 0, 'hot', IF(id % 2 = 0, 'a', NULL)) AS g", "id", "IF(id % 5 = 0, NULL, concat('v', id)) AS v")
    parts = R.concat_parts(df, ["g"], "v", ["id"], part_bytes=500).collect()
    assert max(len(r["text"]) for r in parts) < 520 and len(parts) > 20
    whole = {}
    for r in sorted(parts, key=lambda r: r["part"]):
        whole.setdefault(r["g"], []).append(r["text"])
    assert {g: ", ".join(p) for g, p in whole.items()} == {
        g: ", ".join(f"v{i}" for i in range(3000) if i % 5 and ("hot" if i % 3 else "a" if i % 2 == 0 else None) == g) for g in ("hot", "a")}


def test_value_functions_of_many_counted_rows(spark):
    made = [(i % 3 or None, "ab"[i % 2], float(i * 7 % 41), i % 5, 100 + i) for i in range(200)]
    df = spark.createDataFrame(made, "__k0 int, g string, x double, n int, __k1 int")
    wanted = {"x": ["median", "quantile:0.9", "nunique"], "n": ["mode", "median"], "__k1": ["max"]}
    few = sorted(map(tuple, G.aggregate(df, ["__k0", "g"], wanted).collect()))
    spark.conf.set("cleanloom.quantile.smallRows", "10")
    try:
        many = sorted(map(tuple, G.aggregate(df, ["__k0", "g"], wanted).collect()))
        spark.conf.set("cleanloom.scan.rowsPerChunk", "7")
        cut = sorted(map(tuple, G.aggregate(df, ["__k0", "g"], wanted).collect()))
    finally:
        spark.conf.unset("cleanloom.quantile.smallRows")
        spark.conf.unset("cleanloom.scan.rowsPerChunk")
    assert many == few and cut == few and len(few) == 4
    x = sorted(r[2] for r in made if r[:2] == (1, "a"))
    assert few[0][:3] == (1, "a", (x[len(x) // 2] + x[(len(x) - 1) // 2]) / 2)
