"""Pipelines, checks, profiles, contracts, files, versions and arriving files."""

import pytest
from pyspark.sql import functions as F

from cleanloom import dry_run, register_op, run_plan, validate
from cleanloom.functions.core import OpError
from cleanloom.plans import checks as H, contract as N, modules as M, pipeline as L, profile as P
from cleanloom.sources import blocks as B, files as I, versions as S
from cleanloom.streaming import arrivals as A

from .conftest import rows


def test_failed_step_returns_the_original(people):
    steps = [{"op": "remove_columns", "params": {"columns": ["pay"]}}, {"op": "sort_rows", "params": {"columns": ["pay"]}}]
    stopped = run_plan(people, steps)
    assert not stopped.success and stopped.df.columns == people.columns and "pay" in stopped.steps[1].error
    skipped = run_plan(people, steps, stop_on_error=False)
    assert skipped.success and "pay" not in skipped.df.columns


def test_plan_checks_without_data(people):
    assert validate([{"op": "nope"}, {"op": "rank", "params": {}}, {"op": "rank", "params": {"column": "pay", "colour": 1}}]) == [
        "step 1 (nope): unknown operator 'nope'", "step 2 (rank): missing parameter 'column'", "step 3 (rank): unknown parameter 'colour'"]
    out = dry_run(people, [{"op": "select_columns", "params": {"columns": ["id"]}}, {"op": "row_number", "params": {"order_by": ["id"]}}])
    assert [o["columns"] for o in out] == [["id"], ["id", "row_num"]]


def test_own_operator(people):
    register_op("only_paid", lambda df, least=0: df.where(df.pay > least))
    assert run_plan(people, [{"op": "only_paid", "params": {"least": 200}}]).df.count() == 2
    assert L.custom(people, "SELECT max(pay) AS m FROM {df}").first()["m"] == 5000.0


def test_looking_steps_and_older_plans(people):
    steps = [{"op": "detect_nulls", "params": {"threshold": 0.3}}, {"op": "validate_schema", "params": {"expected_columns": ["id", "zip"]}},
             {"op": "detect_format_drift", "params": {"column": "email", "format_type": "email", "sample_size": 10}}]
    out = run_plan(people, steps)
    assert out.success and out.df.columns == people.columns
    assert ("age", 2, 0.4, True) in rows(L.metrics(people, steps[0]))
    assert rows(L.metrics(people, steps[1])) == [("missing", "zip", "zip", None)]
    assert rows(L.metrics(people, steps[2]), "format", "match_count") == [("expected", 3)]
    older = [{"type": "drop_rows", "target_columns": ["name"]}, {"type": "pad_string", "target_columns": ["email"], "parameters": {"width": 12, "side": "both", "fillchar": "."}},
             {"type": "rename_column", "target_columns": ["pay"], "parameters": {"new_name": "salary"}}, {"type": "flag_duplicates", "target_columns": ["age"]},
             {"type": "merge_columns", "target_columns": ["id", "age"], "parameters": {"separator": "/", "new_column_name": "key"}}]
    done = run_plan(people, [L.older_step(p) for p in older], order_by=["id"])
    assert done.success and done.df.columns == ["id", "name", "email", "age", "salary", "hired", "is_duplicate", "key"]
    assert rows(done.df, "id", "email") == [(1, ".ann@x.org.."), (2, None), (3, "....bad.....")]


def test_header_of_a_frame(spark):
    data = [(1, "Lead export", None, None), (2, "by hand", "", None), (3, "lead_id", "full_name", "score"), (4, "1", "Ann", "70"), (5, "2", "Bob", "80")]
    df = spark.createDataFrame(data, "line int, c0 string, c1 string, c2 string")
    out = run_plan(df, [{"op": "detect_header", "params": {"order_by": ["line"]}}])
    assert out.success and rows(out.df.drop("line"), "lead_id", "full_name", "score") == [("1", "Ann", "70"), ("2", "Bob", "80")]


def test_profile_of_files(spark, folder):
    p = {r["column"]: r["dtype"] for r in M.profile_files(spark, str(folder / "semi.csv")).collect()}
    assert set(p) == {"sku", "price", "qty"}


def test_every_check_can_be_silent(people):
    for kind in ("filter_rows", "sort_rows", "group_by", "fill_nulls", "convert_type", "deduplicate", "join", "normalize", "format_phone", "slice_rows", "drop_rows"):
        issues = H.validate(people, people, {"type": kind, "target_columns": ["id"], "parameters": {"n": 5, "aggregations": {}}})
        bad = {r["check_name"] for r in issues.collect()} - {"filter_actually_filtered", "aggregation_row_count", "deduplicate_success", "phone_format_valid", "numeric_bounds"}
        assert not bad


def test_strict_summary(people):
    issues = H.validate(people, people.where("id < 2"), {"type": "filter_rows"})
    assert H.summarize(issues).first()["passed"] and not H.summarize(issues, strict=True).first()["passed"]
    assert H.assess_risk(people, {"type": "sort_rows"}).first()["risk_level"] == "none"


def test_profile_of_small_table(people):
    p = {r["column"]: r for r in P.profile_table(people).collect()}
    assert p["id"]["semantic_type"] == "id" and p["email"]["semantic_type"] == "email" and p["name"]["semantic_type"] == "name"
    assert (p["age"]["null_count"], p["age"]["null_percent"], p["age"]["median"]) == (2, 40.0, 30.0)
    assert (p["name"]["empty_string_count"], p["name"]["edge_whitespace_count"], p["email"]["invalid_email_count"]) == (1, 1, 1)
    issues = rows(P.column_issues(P.profile_table(people)), "column", "issue")
    assert ("age", "missing_values") in issues and ("email", "invalid_values") in issues


@pytest.fixture(scope="module")
def leads(spark):
    data = [(i, f"n{i}", f"u{i}@x.org", f"555-010-{1000 + i}", ["New", "Won", "Lost"][i % 3]) for i in range(30)]
    return spark.createDataFrame(data, "lead_id int, first_name string, email string, phone_number string, status string")


def match(df, contract, name="f"):
    from pyspark.sql import functions as F

    p = P.column_meanings(df).select(F.lit(name).alias("file"), F.lit("c").alias("contract_id"), "position", "column", "semantic_type", "dtype", "values_sketch")
    return N.match_schema(p, contract)


def test_schema_match_levels(spark, leads):
    contract = N.generate_contract(P.profile_table(leads), "c")
    same = match(leads, contract).first()
    assert same["level"] == "HIGH" and len(same["mappings"]) == 5
    moved = match(leads.select("status", "email", "lead_id", "phone_number", "first_name").withColumnRenamed("phone_number", "tel"), contract).first()
    assert moved["level"] == "HIGH" and {m["incoming"]: m["target"] for m in moved["mappings"]}["tel"] == "phone_number"
    other = spark.createDataFrame([("a", 1.5, 3)], "sku string, weight_kg double, reorder_point int")
    out = match(other, contract).first()
    assert out["level"] == "NO_MATCH" and len(out["missing_required"]) == 5
    kinds = {r["kind"] for r in N.discrepancies(match(leads.drop("status").withColumnRenamed("email", "zzzz"), contract)).collect()}
    assert "missing_required" in kinds


def test_name_scores(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("email", "email"), ("E-Mail", "email"), ("e_mail", "mail"), ("customer", "customers"), ("abc", "xyz")], "a string, b string")
    m = df.select(N.name_match(F.col("a"), F.col("b"), F.array().cast("array<string>")).alias("m")).select("m.*").collect()
    assert [(round(r[0], 4), r[1]) for r in m] == [(1.0, "exact"), (0.95, "normalized"), (0.85, "synonym"), (0.8, "fuzzy"), (0.0, "weak")]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "offset.csv").write_text("Lead export\ngenerated by hand\nlead_id,full_name,score\n1,\"Ann, A\",70\n2,Bob,80\n3,Cy,90\n4,Di,95\n")
    (tmp_path / "semi.csv").write_text("sku;price;qty\nA1;1,50;3\nB2;2,75;4\n")
    (tmp_path / "latin.csv").write_bytes("city|n\nZürich|1\nKöln|2\n".encode("latin-1"))
    return tmp_path


def test_sniffing(spark, folder):
    got = {r["file"].rsplit("/", 1)[1]: r for r in I.sniff(spark, str(folder)).collect()}
    assert {n: (r["encoding"], r["delimiter"], r["header_row"]) for n, r in got.items()} == {
        "offset.csv": ("utf-8", ",", 2), "semi.csv": ("utf-8", ";", 0), "latin.csv": ("latin-1", "|", 0)}
    heads = I.head_lines(spark, str(folder / "semi.csv"), 20)
    assert I.detect_header_row(heads, I.detect_delimiter(heads)).first()["header_row"] == 0


def test_mixed_files_are_read_right(spark, folder):
    df = I.read_csv_safe(spark, str(folder))
    assert rows(df.where("city is not null"), "city", "n") == [("Köln", "2"), ("Zürich", "1")]
    assert rows(df.where("lead_id is not null"), "lead_id", "full_name") == [("1", "Ann, A"), ("2", "Bob"), ("3", "Cy"), ("4", "Di")]
    assert rows(df.where("sku is not null"), "sku", "price", "qty") == [("A1", "1,50", "3"), ("B2", "2,75", "4")]


@pytest.fixture
def odd_folder(tmp_path):
    import gzip

    f = tmp_path / "in [1]"
    f.mkdir()
    (f / "offset.csv").write_text('Lead export\ngenerated by hand\n\nlead_id,full_name,score\n1,"Ann, A",70\n2,Bob,80\n\n3,Cy,90\n4,Di,95\n')
    (f / "semi.csv").write_text("\ufeffsku;price;qty\nA1;1,50;3\nB2;2,75;4\nTotal;4,25;7\n\n;;\n")
    (f / "latin 2.csv").write_bytes("city|n\nZürich|1\nKöln|2\n".encode("latin-1"))
    (f / "dup.csv").write_text('a,a,,b\r\n1,2,3,4\r\n5,"x""y, z",7,8\r\n6,7,8,9\r\n')
    (f / "big.csv").write_bytes(b"id,name\n" + b"".join(b"%d,name %d\n" % (i, i) for i in range(30000)) + b"30000,K\xf6ln\n" + "30001,Köln\nsum,450\n".encode())
    with gzip.open(f / "z.csv.gz", "wt") as g:
        g.write("k,v\n1,a\n2,b\n")
    return f


def test_layouts_come_from_one_block_at_either_end(spark, odd_folder):
    path = str(odd_folder).replace("[", "\\[").replace("]", "\\]")
    got = {r["file"].rsplit("/", 1)[1]: (r["encoding"], r["delimiter"], r["header_row"], r["footer_rows"], r["footer_type"]) for r in I.sniff(spark, path).collect()}
    assert got == {"big.csv": ("utf-8", ",", 0, 1, "summary"), "dup.csv": ("utf-8", ",", 0, 0, None), "latin%202.csv": ("latin-1", "|", 0, 0, None),
                   "offset.csv": ("utf-8", ",", 3, 0, None), "semi.csv": ("utf-8", ";", 0, 3, "summary"), "z.csv.gz": ("utf-8", ",", 0, 0, None)}
    sizes = {r["file"].rsplit("/", 1)[1]: (len(r["head"]), len(r["tail"] or b"")) for r in B.edges(spark, path, 20, 5, 256).collect()}
    assert sizes["big.csv"][0] <= 512 and sizes["big.csv"][1] <= 256


def test_files_of_all_layouts_are_read_in_one_frame(spark, odd_folder):
    path = str(odd_folder).replace("[", "\\[").replace("]", "\\]")
    df = I.read_csv_safe(spark, path, mark_footers=True).cache()
    assert rows(df.where("a is not null"), "a", "`a.1`", "col_2", "b") == [("1", "2", "3", "4"), ("5", 'x"y, z', "7", "8"), ("6", "7", "8", "9")]
    assert rows(df.where("lead_id is not null"), "lead_id", "full_name") == [("1", "Ann, A"), ("2", "Bob"), ("3", "Cy"), ("4", "Di")]
    assert rows(df.where("source_file like '%semi%'"), "sku", "is_footer") == [(None, True), ("A1", False), ("B2", False), ("Total", True)]
    assert rows(df.where("k is not null"), "k", "v") == [("1", "a"), ("2", "b")] and rows(df.where("city is not null"), "city") == [("Köln",), ("Zürich",)]
    big = df.where("source_file like '%big.csv'")
    assert big.count() == 30003 and rows(big.where("is_footer"), "id") == [("sum",)] and rows(big.where("id >= '30000' and length(id) = 5 and id < '30002'"), "name") == [("Köln",), ("Köln",)]
    assert I.read_csv_safe(spark, path, multi_line=True).where("lead_id is not null").count() == 4


def test_profile_without_footers(spark, tmp_path):
    body = "".join(f"{i},item {i % 7},{i * 3}\n" for i in range(200))
    for name, end in (("plain", ""), ("ended", "Total,,59700\n\n,,\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.csv").write_text("key,item,amount\n" + body + end)
    plain, ended = (M.profile_files(spark, str(tmp_path / n)).orderBy("position").collect() for n in ("plain", "ended"))
    assert plain == ended and M.profile_files(spark, str(tmp_path / "ended"), trim_footers=False).first()["row_count"] == 202


def test_footers(spark):
    data = [("a", i, str(i), "x", "y") for i in range(6)] + [("a", 6, "Total", "15", None), ("a", 7, None, None, "z")]
    data += [("b", 0, "Total", "1", "y"), ("b", 1, "2", "3", "y")]
    df = spark.createDataFrame(data, "file string, row int, c1 string, c2 string, c3 string")
    assert rows(I.detect_footer_rows(df, ["c1", "c2", "c3"])) == [("a", 2, "summary"), ("b", 0, None)]


def test_versions(spark, people, tmp_path):
    v = S.Versions(spark, str(tmp_path))
    a = v.create(people, "s")
    b = v.create(people.drop("pay"), "s", a, [{"op": "remove_columns", "params": {"columns": ["pay"]}}])
    assert [r["id"] for r in v.lineage(b).collect()] == [a, b]
    assert v.saved_steps(b) == [{"op": "remove_columns", "params": {"columns": ["pay"]}}]
    assert v.undo(b)[0] == a and v.undo(b)[1].columns == people.columns


def test_version_profiles_merge(spark, tmp_path):
    """A profile merged over appended versions says what one of the whole table says; sketches keep their stated errors."""
    data = [(i, float(i * 37 % 9001) if i % 5 else None, None if i % 7 == 0 else f" V{i % 50} ", [i]) for i in range(9000)]
    df = spark.createDataFrame(data, "id long, x double, name string, parts array<long>")
    v = S.Versions(spark, str(tmp_path))
    a = v.create(df.where("id < 2000"), "s")
    b = v.append(df.where("id >= 2000 AND id < 2500").select("parts", "name", "x", "id"), "s", a)
    c = v.append(df.where("id >= 2500"), "s", b)
    d = v.append(df.where("id < 0"), "s", c)
    whole = v.create(df, "s")
    exact = ["column", "row_count", "null_count", "min_value", "max_value", "mean", "std"]
    merged = {r["column"]: r for r in v.profile(d).collect()}
    for r in v.profile(whole).collect():
        assert [merged[r["column"]][k] for k in exact] == [r[k] for k in exact]
    assert merged["name"]["unique_count"] == 50 and merged["parts"]["unique_count"] == 0 and merged["parts"]["null_count"] == 0
    assert abs(merged["id"]["unique_count"] / 9000 - 1) < 5 / 64
    xs = sorted(x[1] for x in data if x[1] is not None)
    assert abs(sum(x <= merged["x"]["median"] for x in xs) / len(xs) - 0.5) < 0.01
    assert rows(v.read(c).drop("parts")) == rows(df.drop("parts")) and v.read(b).count() == 2500 and v.node(c)["row_count"] == 9000
    assert len(list((tmp_path / "snapshots" / b).glob("*.parquet"))) and spark.read.parquet(str(tmp_path / "snapshots" / b)).count() == 500
    with pytest.raises(OpError):
        v.append(df.drop("x"), "s", a)
    e = v.create(df.where("id < 0"), "s")
    assert v.profile(e).first()["row_count"] == 0
    assert {r["column"]: r["mean"] for r in v.profile(v.append(df, "s", e)).collect()}["id"] == 4499.5


def test_gate_and_arrivals(spark, leads, tmp_path):
    steps = [{"op": "change_text_casing", "params": {"column": "status", "case": "upper"}}]
    module = M.build_module(leads, steps, "c")
    assert M.run_module(spark.range(3).withColumnRenamed("id", "zz"), module).status == "failed"
    inbox, out = tmp_path / "in", tmp_path / "out"
    inbox.mkdir()
    pdf = leads.toPandas()
    pdf.to_csv(inbox / "one.csv", index=False)
    A.stream_module_run(spark, str(inbox), module, str(out), str(tmp_path / "ck")).awaitTermination()
    pdf[["status", "email", "phone_number", "first_name", "lead_id"]].to_csv(inbox / "two.csv", index=False, sep=";")
    (inbox / "three.csv").write_text("sku,weight\nA,1\nB,2\n")
    A.stream_module_run(spark, str(inbox), module, str(out), str(tmp_path / "ck")).awaitTermination()
    done = spark.read.parquet(str(out / "output"))
    assert done.count() == 60 and {r["status"] for r in done.select("status").distinct().collect()} == {"NEW", "WON", "LOST"}
    records = rows(A.run_records(spark, str(out)), "level", "status")
    assert records == [("HIGH", "success"), ("HIGH", "success"), ("NO_MATCH", "failed")]
    assert spark.read.parquet(str(out / "rejected")).count() == 2


ORDERED = [{"op": "running_total", "params": {"column": "v", "new_column": "total"}}, {"op": "cumulative", "params": {"target_columns": ["v", "w"], "operation": "mean"}},
           {"op": "row_number", "params": {}}, {"op": "running_total", "params": {"column": "total", "new_column": "twice"}},
           {"op": "fill_forward", "params": {"columns": ["w"]}}, {"op": "lag", "params": {"column": "v"}}]


def ordered_input(spark):
    return spark.range(300).selectExpr("id", "CASE WHEN id % 7 <> 0 THEN CAST(id % 11 AS double) END AS v", "CASE WHEN id % 3 = 0 THEN CAST(id AS double) END AS w").repartition(4)


def test_running_columns_of_one_order_are_one_scan(spark, chunks, monkeypatch):
    from cleanloom.functions import scan

    df = ordered_input(spark)
    one_by_one = df
    for step in ORDERED:
        one_by_one = L.get_op(step["op"])(one_by_one, **step["params"], order_by=["id"])
    cuts, scans = [], []
    bounds, running = scan._bounds, scan.running
    monkeypatch.setattr(scan, "_bounds", lambda *a: cuts.append(1) or bounds(*a))
    monkeypatch.setattr(scan, "running", lambda *a: scans.append(1) or running(*a))
    out = run_plan(df, ORDERED, order_by=["id"])
    assert out.success and out.df.columns == one_by_one.columns and len(cuts) == 1 and len(scans) == 2
    assert [r.columns for r in out.steps][1] == ["id", "v", "w", "total", "v_cummean", "w_cummean"] and out.steps[-1].columns == out.df.columns
    assert rows(out.df) == rows(one_by_one)


def test_cuts_are_forgotten_when_rows_change(spark, chunks, monkeypatch):
    from cleanloom.functions import scan

    cuts, bounds = [], scan._bounds
    monkeypatch.setattr(scan, "_bounds", lambda *a: cuts.append(1) or bounds(*a))
    steps = [ORDERED[0], {"op": "filter_rows", "params": {"conditions": [{"column": "v", "operator": "gt", "value": 3}]}}, {"op": "lag", "params": {"column": "v"}},
             {"op": "math_operation", "params": {"column_a": "id", "operation": "multiply", "column_b": -1, "new_column": "id"}}]
    out = run_plan(ordered_input(spark), steps[:3] + [{"op": "lead", "params": {"column": "v"}}], order_by=["id"])
    assert out.success and len(cuts) == 2


def test_record_of_a_run(spark):
    steps = [{"op": "filter_rows", "params": {"conditions": [{"column": "v", "operator": "gt", "value": 3}]}}, ORDERED[0], ORDERED[2]]
    out = run_plan(ordered_input(spark), steps, order_by=["id"], observe=True)
    n = out.df.count()
    assert [(r["step"], r["op"], r["rows"], r["columns"]) for r in out.record()] == [(1, "filter_rows", n, 3), (2, "running_total", n, 4), (3, "row_number", n, 5)]
    assert all(r["ms"] > 0 for r in out.record())


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_profile_sends_no_column_to_one_task(spark):
    df = spark.range(3000).selectExpr("id", "concat('V', id % 700) AS s", "IF(id % 3 = 0, NULL, id * 0.5) AS x", "'' AS e", "CAST(NULL AS string) AS n")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("cleanloom.quantile.smallRows", "10")
    try:
        got = P.profile_table(df)
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
        got = {r["column"]: r for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("cleanloom.quantile.smallRows")
    first = lambda c: [r[0] for r in df.where(f"{c} IS NOT NULL").select(F.col(c).cast("string").alias("v")).distinct().orderBy(F.xxhash64("v"), "v").limit(5).collect()]
    for c in df.columns:
        assert got[c]["sample_values"] == first(c), c
    want = df.select(*[F.percentile(F.col("x").cast("double"), p) for p in (0.25, 0.5, 0.75)]).first()
    assert (got["x"]["q1"], got["x"]["median"], got["x"]["q3"]) == tuple(want)
    assert (got["s"]["unique_count"], got["s"]["unique_lower_count"], got["id"]["unique_lower_count"], got["n"]["unique_lower_count"]) == (700, 700, 3000, 0)
    assert got["s"]["top_values"] is None and [v["count"] for v in got["e"]["top_values"]] == [3000]


def test_values_are_stripped_once(spark):
    counts = P.value_counts(spark.createDataFrame([(v,) for v in (" a@b.co ", "10%", "$5", "1/2/2024", "Yes", "12:30", "2024-01-05T10:00", "http://x", "5 €", "1.2.2024")], "v string"))
    plan = plan_of(P.value_metrics(counts))
    assert plan.count("regexp_replace") <= 2
    hits = P.value_metrics(counts).first()
    assert [hits[f"hit_{p}"] for p in ("email", "percentage", "currency", "date_us", "boolean", "time", "datetime_iso", "url", "date_eu")] == [1, 1, 2, 1, 1, 1, 1, 1, 1]


def test_footers_move_no_cells(spark):
    df = spark.createDataFrame([("a", 1, "1", "x"), ("a", 2, "Total", "3"), ("a", 3, None, None), ("b", 1, "2", "y"), ("c", 1, None, None)], "file string, row int, c1 string, c2 string")
    got = I.detect_footer_rows(df, ["c1", "c2"])
    plan = plan_of(got)
    assert "collect_list" not in plan and "c1" not in plan[: plan.index("Window")]
    assert rows(got) == [("a", 2, "summary"), ("b", 0, None), ("c", 1, "empty")]
    assert got.schema["footer_rows"].dataType.simpleString() == "int"
