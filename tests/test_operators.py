"""Null, empty, one-row and missing-column cases of the operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cleanloom import OpError
from cleanloom.functions import quantiles
from cleanloom.operators import calculate as K, columns as C, dates as D, format as M, groups as G, quality as V, rows as R, tables as J, text as X

from .conftest import rows


def test_null_truth_of_predicates(people):
    ids = lambda conds, **k: [r[0] for r in rows(R.filter_rows(people, conds, **k), "id")]
    assert ids([{"column": "email", "operator": "eq", "value": "BAD"}]) == [3]
    assert ids([{"column": "email", "operator": "eq", "value": "bad"}], keep=False) == [1, 2, 4, 5]
    assert ids([{"column": "email", "operator": "ne", "value": "bad"}]) == [1, 2, 4, 5]
    assert ids([{"column": "email", "operator": "not_in", "value": ["bad"]}]) == [1, 2, 4, 5]
    assert ids([{"column": "age", "operator": "gt", "value": 35}, {"column": "pay", "operator": "isnull"}], logic="or") == [3]
    assert ids([{"column": "hired", "operator": "is_date"}]) == [1, 2, 3]
    assert ids([{"column": "name", "operator": "contains", "value": "o'b"}]) == [1]


@pytest.mark.parametrize("call", [
    lambda d: R.filter_rows(d, [{"column": "nope", "operator": "eq", "value": 1}]), lambda d: R.filter_rows(d, []), lambda d: R.sort_rows(d, ["nope"]),
    lambda d: R.head_rows(d, 3), lambda d: R.limit_rows(d, -1, order_by=["id"]), lambda d: R.sample_rows(d, 1, 0.5), lambda d: R.sample_rows(d, fraction=2.0),
    lambda d: C.select_columns(d, ["nope"]), lambda d: C.remove_columns(d, ["nope"]), lambda d: C.rename_columns(d, {"id": "name"}), lambda d: C.add_column(d, "id", 1),
    lambda d: K.math_operation(d, "x", "divide", "pay", value=0), lambda d: K.rank(d, "pay", method="odd"), lambda d: X.regex_replace(d, "name", "(", ""),
    lambda d: X.pad_text(d, "name", 5, "ab"), lambda d: D.extract_date_part(d, "hired", "era"), lambda d: J.union_tables(d.select("id"), [d.select("pay")]),
    lambda d: V.validate_pattern(d, "email"), lambda d: R.fill_blanks(d, "age", "value"), lambda d: K.case_when(d, [{"condition": {"column": "id", "operator": "odd"}, "result": 1}], "x")])
def test_bad_steps_are_refused(people, call):
    with pytest.raises(OpError):
        call(people)


def test_fills_and_casts(people):
    assert [r[1] for r in rows(R.fill_blanks(people, "age", "mode"), "id", "age")] == [30.0, 30.0, 41.0, 30.0, 30.0]
    assert [r[1] for r in rows(R.fill_nulls(people, ["age", "pay"], "median"), "id", "pay")] == [100.0, 250.5, 175.25, 75.0, 5000.0]
    got = rows(C.change_column_type(people, "hired", "datetime"), "id", "hired")
    assert [r[1] for r in got] == [dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 7), dt.datetime(2024, 1, 9), None, None]
    assert C.change_column_type(people, "hired", "float", errors="ignore").schema["hired"].dataType.simpleString() == "string"
    with pytest.raises(Exception, match="cannot read as float"):
        C.change_column_type(people, "hired", "float", errors="raise").collect()


def test_text_rules(people):
    assert rows(M.change_text_casing(people, "name", "title"), "id", "name")[0] == (1, " Ann O'Brien ")
    assert [r[1] for r in rows(M.trim_whitespace(people), "id", "name")] == ["Ann O'brien", "BOB", "cy", None, ""]
    assert [r[1] for r in rows(X.string_contains(people, "email", "x.", "hit"), "id", "hit")] == [True, False, False, True, True]
    assert [r[1] for r in rows(X.mask_data(people, ["email"], "email"), "id", "email")] == ["a**@x.org", None, "***", "d**@x.org", "e**@x.org"]
    assert [r[1] for r in rows(X.substring(people, "email", -3), "id", "email")] == ["org", None, "bad", "org", "org"]
    assert [r[1] for r in rows(X.substring(people, "email", 2, 100), "id", "email")][2] == "d"


def test_double_as_text(spark):
    df = spark.createDataFrame([(1e7,), (0.5,), (17.0,), (None,)], "x double")
    assert [r[0] for r in C.change_column_type(df, "x", "string").collect()] == ["10000000.0", "0.5", "17.0", None]


def test_doubles_as_text_keep_all_digits(spark):
    values = [1e-12, 2e-12, 3.25e-11, 1e300, -1.5e-7, 123456789.125, 12345678901234567.0, 0.1 + 0.2, -2.5e10, 5e-324, float("inf"), float("-inf"), float("nan"), 0.0, -1e22]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    got = [r[0] for r in C.change_column_type(df, "x", "string").orderBy("i").select("x").collect()]
    assert all("E" not in g.replace("NaN", "") and (float(g) == v or v != v) for g, v in zip(got, values))
    assert got[:3] == ["0.000000000001", "0.000000000002", "0.0000000000325"] and got[5:7] == ["123456789.125", "12345678901234568.0"]
    assert len(set(got)) == len(values)
    one = [r[0] for r in C.change_column_type(spark.createDataFrame([(1e7,), (1e21,)], "x double"), "x", "string").collect()]
    assert one == ["10000000.0", "1" + "0" * 21 + ".0"]


@pytest.mark.parametrize("values", [[1.0, 2.0, 2.0, 7.0], [1.0, float("inf")], [float("-inf"), 1.0, float("inf")], [1.0, 5.0, float("nan")], [1e300, 1e-12, -1e300, 3.0, 3.0], [float("inf")] * 3, [4.0]])
def test_quantiles_agree_on_both_sides_of_the_switch(spark, values):
    df = spark.createDataFrame([("g", v) for v in values] + [("g", None)], "g string, x double")
    seen = []
    for small in ("1000000", "0"):
        spark.conf.set("cleanloom.quantile.smallRows", small)
        seen.append([repr(v) for v in quantiles.quantiles(df, ["g"], "x", [0.0, 0.25, 0.5, 0.9, 1.0]).first()])
    spark.conf.unset("cleanloom.quantile.smallRows")
    assert seen[0] == seen[1]


def test_header_words():
    names = ["First Name", "orderID", "  a__b ", "Prix (€) Net", "é à", "_x", "HTMLPage", "aB cD"]
    assert [C.snake_words(C.header_words(n)) for n in names] == ["first_name", "order_id", "a_b", "prix_net", "é_à", "x", "htmlpage", "a_b_c_d"]
    assert [C.camel_words(C.header_words(n)) for n in names] == ["firstName", "orderid", "aB", "prixNet", "éÀ", "x", "htmlpage", "abCd"]


def test_large_sample_without_a_seed(spark):
    assert R.sample_rows(spark.range(3000), n=1500).distinct().count() == 1500


def test_bins_label_like_intervals(spark):
    df = spark.range(1, 11).withColumnRenamed("id", "x")
    got = [r[0] for r in K.bin_values(df, "x", 3, "b").select("b").distinct().orderBy("b").collect()]
    assert got == ["(0.99, 4.0]", "(4.0, 7.0]", "(7.0, 10.0]"]
    got = [r[0] for r in K.bin_numeric(df, ["x"], "quantile", 4).select("x_bin").distinct().orderBy("x_bin").collect()]
    assert got == ["(0.999, 3.25]", "(3.25, 5.5]", "(5.5, 7.75]", "(7.75, 10.0]"]
    got = {r["b"] for r in K.bin_values(df, "x", [0, 18, 35], "b").collect()}
    assert got == {"(-0.001, 18.0]"}


def test_constant_columns(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (None,)], "x double")
    assert rows(K.normalize(df, ["x"])) == [(None,), (0.0,), (0.0,)]
    assert K.handle_outliers(df, ["x"], "flag").where("x_outlier").count() == 0
    zero = spark.createDataFrame([(0.0,), (0.0,)], "x double")
    assert [r["p"] for r in K.percentage(zero, "x", "p").collect()] == [0.0, 0.0]


def test_empty_and_one_row(spark, people):
    for df in (people.where("false"), people.limit(1)):
        n = df.count()
        for out in (K.running_total(df, "pay", "t", order_by=["id"]), R.row_number(df, order_by=["id"]), K.rank(df, "pay", "r"), K.lag(df, "pay", "l", order_by=["id"]),
                    K.normalize(df, ["pay"]), R.fill_blanks(df, "pay", "median"), V.is_duplicate(df, ["name"], order_by=["id"]), K.bin_values(df, "pay", 3),
                    R.remove_duplicates(df, ["name"], order_by=["id"]), K.moving_average(df, "pay", 3, order_by=["id"])):
            assert out.count() == n


def test_aggregate_nulls(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", None, 2), (None, 3.0, 3), ("b", 4.0, 4), ("b", None, 5)], "g string, v double, k int")
    assert rows(G.aggregate(df, "g", {"v": ["sum", "first", "last", "median"]}, order_by=["k"])) == [("a", 0.0, None, None, None), ("b", 4.0, 4.0, 4.0, 4.0)]
    assert rows(R.merge_duplicates(df, "g", {"v": "concat"}, order_by=["k"]), "g", "v") == [("a", ""), ("b", "4.0")]


def test_join_shapes(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string")
    b = spark.createDataFrame([(None, "z"), (2, "w")], "k int, v string")
    assert rows(J.join_tables(a, b, "k", how="outer")) == [(None, "y", "z"), (1, "x", None), (2, None, "w")]
    assert J.join(a, b, "k").columns == ["k", "v", "v_right"]


def test_explode_and_split(spark):
    df = spark.createDataFrame([(1, "a, b"), (2, None), (3, "")], "id int, t string")
    assert rows(R.explode_column(df, "t")) == [(1, "a"), (1, "b"), (2, None), (3, "")]
    assert rows(C.split_column(df, "t", ",", ["p", "q"])) == [(1, "a", " b"), (2, None, None), (3, "", None)]


def test_uuid_forms(spark):
    df = C.generate_uuid(spark.range(5), "u", "uuid4", "id-")
    assert df.where(F.col("u").rlike("^id-[0-9a-f-]{36}$")).count() == 5
    assert C.generate_uuid(spark.range(5), "u", "short").where("length(u) = 8").count() == 5


def test_booleans_and_enums(spark):
    df = spark.createDataFrame([("Yes",), ("off",), ("",), ("eh",), (None,)], "f string")
    assert [r[0] for r in V.normalize_boolean(df, "f").collect()] == [True, False, False, None, None]
    assert [r[0] for r in V.normalize_boolean(df, "f", output_format="string", null_handling="false").collect()] == ["true", "false", "false", None, "false"]
    with pytest.raises(Exception, match="unmapped"):
        V.normalize_enum_values(df, "f", {"yes": "y"}, unmapped_handling="error").collect()
    big = {f"v{i}": str(i) for i in range(500)}  # above the literal-map size: joined
    many = spark.createDataFrame([("V7",), ("x",)], "f string")
    assert rows(M.standardize_values(many, "f", big)) == [("7",), ("x",)]


def test_dates(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-31 06:00:00' AS a, timestamp_ntz'2024-01-31 00:00:00' AS b")
    assert D.date_diff(df, "a", "b", "days", "d").first()["d"] == -1
    assert D.date_add(df, "a", 1, "months", "m").first()["m"] == dt.datetime(2024, 2, 29, 6)
    texts = ["2024-03-04", "3/4/2024", "25/12/2023", "Mar 4 2024", "March 4, 2024 9:30 PM", "4.3.2024", "2024-03-04T10:11:12", "2024/3/4 7:05", "13-13-2024", "n/a"]
    got = [r[0] for r in C.change_column_type(spark.createDataFrame([(x,) for x in texts], "d string"), "d", "datetime").collect()]
    day = dt.datetime(2024, 3, 4)
    assert got == [day, day, dt.datetime(2023, 12, 25), day, day.replace(hour=21, minute=30), day, day.replace(hour=10, minute=11, second=12),
                   day.replace(hour=7, minute=5), None, None]


@pytest.mark.parametrize("case_sensitive", [False, True])
def test_mappings_agree_as_literal_and_as_join(spark, monkeypatch, case_sensitive):
    cells = ["a", "A", "b", "", None, "c", "É", "a", "z"] + [f"v{i}" for i in range(300)]
    df = spark.createDataFrame(list(enumerate(cells)), "id long, name string")
    mapping = {"a": "one", "A": "two", "b": None, "": "empty", "é": "e", **{f"v{i}": f"w{i % 7}" for i in range(0, 300, 2)}}
    got = []
    for most in (0, 10_000):
        monkeypatch.setattr(M, "LITERAL_MAP", most)
        got.append(rows(M.standardize_values(df, "name", mapping, case_sensitive), "id", "name"))
    assert got[0] == got[1]
    values = dict(got[0])
    assert values[0] == ("one" if case_sensitive else "two") and values[2] == "b" and values[3] == "empty" and values[4] is None and values[9] == "w0" and values[10] == "v1"
