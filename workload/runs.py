"""Plans, modules, versions, files and arriving files."""

from pyspark.sql import functions as F

from cleanloom.plans import modules as M, pipeline as L
from cleanloom.sources import files as I, versions as S
from cleanloom.streaming import arrivals as A

from .base import LINE_ORDER, shared_folder, t

FLAGSHIP = [
    {"op": "filter_rows", "params": {"conditions": [{"column": "l_returnflag", "operator": "ne", "value": "R"}]}},
    {"op": "add_expression", "params": {"expression": "l_extendedprice * (1 - l_discount)", "name": "revenue"}},
    {"op": "aggregate", "params": {"group_by": ["l_returnflag", "l_linestatus"], "aggregations": {"revenue": ["sum", "mean"], "l_quantity": ["sum"], "l_orderkey": ["count"]}}},
    {"op": "rank", "params": {"column": "revenue_sum", "new_column": "place", "ascending": False, "method": "min"}},
    {"op": "round_numbers", "params": {"column": ["revenue_sum", "revenue_mean"], "decimals": 2}},
    {"op": "sort_rows", "params": {"columns": ["place"]}},
]

CLEANING = [
    {"op": "trim_whitespace", "params": {"columns": ["name"]}},
    {"op": "split_column", "params": {"column": "name", "delimiter": "#", "new_columns": ["kind", "number"]}},
    {"op": "change_column_type", "params": {"column": "number", "to_type": "integer"}},
    {"op": "lookup", "params": {"lookup_table": "nation", "lookup_column": "nation_key", "lookup_key": "n_nationkey", "return_columns": ["n_name"]}},
    {"op": "bin_values", "params": {"column": "balance", "bins": [-10000, 0, 5000, 20000], "labels": ["debt", "low", "high"]}},
    {"op": "deduplicate", "params": {"subset": ["n_name", "balance_bin"], "keep": "first"}},
    {"op": "running_total", "params": {"column": "balance", "new_column": "total", "group_by": ["n_name"]}},
]


def named_customers(s, d):
    return t(s, d, "customer").selectExpr("c_custkey AS customer_id", "concat(' ', c_name) AS name", "c_nationkey AS nation_key", "c_acctbal AS balance", "c_mktsegment AS segment")


def cleaning_run(s, d):
    return L.run_plan(named_customers(s, d), CLEANING, {"nation": t(s, d, "nation")}, order_by=["customer_id"]).df.selectExpr(
        "customer_id", "number", "kind", "n_name", "balance", "balance_bin", "segment", "nation_key", "bround(total, 4) AS total")


def step_counts(s, d):
    steps = [{"op": "filter_rows", "params": {"conditions": [{"column": "o_orderstatus", "operator": "eq", "value": "O"}]}}, {"op": "no_such_step", "params": {}},
             {"op": "remove_duplicates", "params": {"subset": ["o_custkey"]}}]
    return L.run_plan(t(s, d, "orders"), steps, stop_on_error=False, order_by=["o_orderkey"], count_rows=True).counts


OLDER = [
    {"type": "drop_rows", "conditions": [{"column": "o_orderstatus", "operator": "eq", "value": "P"}]},
    {"type": "rename_column", "target_columns": ["o_orderpriority"], "parameters": {"new_name": "priority"}},
    {"type": "substring", "target_columns": ["priority"], "parameters": {"after": "-"}},
    {"type": "pad_string", "target_columns": ["priority"], "parameters": {"width": 15, "side": "right", "fillchar": "."}},
    {"type": "extract_date_part", "target_columns": ["o_orderdate"], "parameters": {"parts": ["year"]}},
    {"type": "flag_duplicates", "target_columns": ["o_custkey"]},
    {"type": "cumulative", "target_columns": ["o_totalprice"], "parameters": {"operation": "max"}},
    {"type": "drop_columns", "target_columns": ["o_orderdate", "nope"]},
]


def older_run(s, d):
    return L.run_plan(t(s, d, "orders"), [L.older_step(p) for p in OLDER], order_by=["o_orderkey"]).df


def header_of_table(s, d):
    """orders as text below two junk lines and their header, read without a header"""
    body = t(s, d, "orders").selectExpr("o_orderkey + 3 AS line", "CAST(o_orderkey AS string) AS c0", "o_orderstatus AS c1", "CAST(o_custkey AS string) AS c2")
    top = s.sql("SELECT * FROM VALUES (0L, 'Order export', NULL, NULL), (1L, 'made by hand', NULL, NULL), (2L, 'order_id', 'status', 'customer') AS v(line, c0, c1, c2)")
    return L.run_plan(top.unionByName(body), [{"op": "detect_header", "params": {"order_by": ["line"]}}]).df.select("order_id", "status", "customer")


def findings(s, d):
    return L.metrics(t(s, d, "orders"), {"op": "detect_enum_drift", "params": {"column": "o_orderstatus", "expected_values": ["O", "Q"], "add_drift_flag": True}})


MODULE_STEPS = [{"op": "change_text_casing", "params": {"column": "segment", "case": "title"}},
                {"op": "aggregate", "params": {"group_by": "segment", "aggregations": {"balance": ["sum", "count"]}}}]


def module_run(s, d):
    module = M.build_module(named_customers(s, d), MODULE_STEPS, "customers")
    incoming = t(s, d, "customer").selectExpr("c_mktsegment AS Segment", "c_acctbal AS BALANCE", "c_custkey AS customer_ID", "c_name AS `Name`", "c_nationkey AS nationkey")
    return M.run_module(incoming, module, "customers_2.csv").output.selectExpr("segment", "bround(balance_sum, 4) AS balance_sum", "balance_count")


def module_gate(s, d):
    module = M.build_module(named_customers(s, d), MODULE_STEPS, "customers")
    good = M.run_module(named_customers(s, d), module, "good").record
    bad = M.run_module(t(s, d, "events").select("ts", "props"), module, "bad").record
    return good.unionByName(bad).selectExpr("file", "contract_id", "level", "status")


def version_history(s, d):
    v = S.Versions(s, shared_folder(s))
    root = v.create(t(s, d, "customer"), "session", None, [], "upload", "v1")
    steps = [{"op": "filter_rows", "params": {"conditions": [{"column": "c_acctbal", "operator": "gte", "value": 0}]}}]
    second = v.create(L.run_plan(v.read(root), steps).df, "session", root, steps, "solvent", "v2")
    third = v.create(v.read(second).drop("c_acctbal"), "session", second, [{"op": "remove_columns", "params": {"columns": ["c_acctbal"]}}], "no balance", "v3")
    return v.lineage(third, 3).selectExpr("id", "parent_id", "row_count", "column_count", "description", "CAST(level AS bigint) AS level")


def version_undo(s, d):
    v = S.Versions(s, shared_folder(s))
    v.create(t(s, d, "customer"), "session", None, [], "upload", "v1")
    v.create(t(s, d, "customer").where("c_acctbal >= 0"), "session", "v1", [], "solvent", "v2")
    return v.undo("v2")[1]


def appended_profile(s, d):
    """Orders in three versions, each of a year's range appended to the one before: the last one's profile, merged from the three.
    Distinct values are shown as far as the sketches are exact."""
    v, orders = S.Versions(s, shared_folder(s)), t(s, d, "orders").withColumn("o_orderstatus", F.expr("nullif(o_orderstatus, 'P')"))
    year = F.year("o_orderdate")
    v.create(orders.where(year < 1994), "session", None, [], "first", "v1")
    v.append(orders.where((year >= 1994) & (year < 1997)), "session", "v1", "second", "v2")
    v.append(orders.where((year >= 1997) | year.isNull()).select(*reversed(orders.columns)), "session", "v2", "third", "v3")
    return v.profile("v3").select("column", "row_count", "null_count", F.when(F.col("unique_count") <= 3500, F.col("unique_count")).alias("unique_count"), "min_value", "max_value", "mean", "std")


def appended_rows(s, d):
    v, c = S.Versions(s, shared_folder(s)), t(s, d, "customer")
    v.create(c.where("c_acctbal < 0"), "session", None, [], "debt", "v1")
    v.append(c.where("c_acctbal >= 0 OR c_acctbal IS NULL"), "session", "v1", "the rest", "v2")
    return v.read("v2")


def order_chain(s, d):
    """ancestors of the last order, following the customer's previous order"""
    nodes = t(s, d, "orders").selectExpr("CAST(o_orderkey AS string) AS id", "CAST(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS string) AS parent_id", "o_totalprice")
    last = str(t(s, d, "orders").agg(F.max("o_orderkey")).first()[0])
    return S.lineage(nodes, last, 4).selectExpr("id", "parent_id", "o_totalprice", "CAST(level AS bigint) AS level")


def mixed_files(s, d):
    """customers as comma files and suppliers as semicolon files with other columns, read together"""
    folder = shared_folder(s)
    c = t(s, d, "customer").selectExpr("c_custkey AS key", "concat(c_name, ', Inc') AS name", "c_acctbal AS balance")
    p = t(s, d, "supplier").selectExpr("s_name AS name", "s_suppkey AS key", "s_acctbal AS balance", "s_nationkey AS nation")
    I.write_csv(c, f"{folder}/comma")
    p.write.csv(f"{folder}/semi", header=True, sep=";")
    return I.read_csv_safe(s, [f"{folder}/comma", f"{folder}/semi"]).select("key", "name", "balance", "nation")


def sniffed(s, d):
    folder = shared_folder(s)
    t(s, d, "orders").write.csv(f"{folder}/a", header=True, sep="|")
    t(s, d, "supplier").coalesce(1).write.csv(f"{folder}/b", header=True, sep="\t")
    out = I.sniff(s, [f"{folder}/a", f"{folder}/b"])
    return out.select("encoding", "delimiter", "header_row", F.concat_ws(",", "fields").alias("fields")).distinct()


def header_rows(s, d):
    """the header place by the second scoring rule, beside the size of the table it came from"""
    folder = shared_folder(s)
    t(s, d, "customer").coalesce(1).write.csv(folder, header=True)
    heads = I.head_lines(s, folder, 20)
    found = I.detect_header_row(heads, I.detect_delimiter(heads)).select("header_row", "confidence")
    n = I.lines(s, folder).agg(F.count(F.lit(1)).alias("n")).scalar()
    return found.withColumn("lines", n)


def footers(s, d):
    """line items per order with a total row and a blank row at the end"""
    lines = t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    # an order's lines lie in one of as many parts as the rows ask for, so that a task's memory does not grow with the table
    parts = max(int(s.conf.get("spark.sql.shuffle.partitions")), lines.count() // 500_000 + 1)
    li = lines.repartition(parts, "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("q"))
    data = li.selectExpr("l_orderkey AS file", "l_linenumber AS row", "CAST(l_linenumber AS string) AS a", "CAST(q AS string) AS b", "'x' AS c")
    total = li.groupBy("l_orderkey").agg(F.sum("q").alias("q")).selectExpr("l_orderkey AS file", "100 AS row", "'Total' AS a", "CAST(q AS string) AS b", "'' AS c")
    blank = li.where("l_orderkey % 2 = 0").select("l_orderkey").distinct().selectExpr("l_orderkey AS file", "101 AS row", "CAST(NULL AS string) AS a", "CAST(NULL AS string) AS b", "'x' AS c")
    return I.detect_footer_rows(data.unionByName(total).unionByName(blank), ["a", "b", "c"])


def exported(s, d):
    folder = shared_folder(s)
    I.export(t(s, d, "orders"), f"{folder}/x", "json", 500, ["o_orderkey"])
    return s.read.schema("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double").json(f"{folder}/x")


def csv_round_trip(s, d):
    folder = shared_folder(s)
    I.write_csv(t(s, d, "documents").select("doc_id", "lang", "source"), f"{folder}/x")
    return I.read_csv(s, f"{folder}/x").selectExpr("CAST(doc_id AS bigint) AS doc_id", "lang", "source")


def arrivals(s, d):
    folder = shared_folder(s)
    module = M.build_module(named_customers(s, d), MODULE_STEPS, "customers")
    named_customers(s, d).coalesce(2).write.csv(f"{folder}/in/a", header=True)
    named_customers(s, d).select("segment", "balance", "nation_key", "name", "customer_id").coalesce(1).write.csv(f"{folder}/in/b", header=True, sep=";")
    A.stream_module_run(s, f"{folder}/in/*", module, f"{folder}/out", f"{folder}/ckpt").awaitTermination()
    out = s.read.parquet(f"{folder}/out/output")
    return out.selectExpr("segment", "bround(balance_sum, 4) AS balance_sum", "balance_count", "CAST(layout AS bigint) AS layout").drop("layout")


ORDERED_STEPS = [{"op": "running_total", "params": {"column": "balance", "new_column": "total"}},
                 {"op": "lookup", "params": {"lookup_table": "nation", "lookup_column": "nation_key", "lookup_key": "n_nationkey", "return_columns": ["n_name"]}}]


def ordered_arrivals(s, d):
    """a stream over a module with an ordered step and a lookup, files it must reject, and the whole batch once more"""
    folder = shared_folder(s)
    module = M.build_module(named_customers(s, d), [{"op": "change_column_type", "params": {"column": c, "to_type": k}} for c, k in (("balance", "double"), ("nation_key", "integer"))] + ORDERED_STEPS, "customers")
    named_customers(s, d).orderBy("customer_id").write.csv(f"{folder}/in/a", header=True)  # files in the order of their names
    t(s, d, "events").select("ts", "props").write.csv(f"{folder}/in/b", header=True)
    nation = {"nation": t(s, d, "nation")}
    A.stream_module_run(s, f"{folder}/in/*", module, f"{folder}/out", f"{folder}/ckpt", tables=nation).awaitTermination()
    A.run_files(s, [f"{folder}/in/a", f"{folder}/in/b"], M.load_module(s, f"{folder}/out/module"), f"{folder}/out", 0, tables=nation)
    out = s.read.parquet(f"{folder}/out/output").selectExpr("CAST(customer_id AS bigint) AS customer_id", "n_name", "bround(total, 2) AS total")
    return out.withColumn("records", A.run_records(s, f"{folder}/out").agg(F.count(F.lit(1))).scalar())


CHAIN = [{"op": "running_total", "params": {"column": "l_quantity", "new_column": "quantity_so_far"}}, {"op": "cumulative", "params": {"target_columns": ["l_extendedprice"], "operation": "max"}},
         {"op": "cumulative", "params": {"target_columns": ["l_discount"], "operation": "count"}}, {"op": "row_number", "params": {}}, {"op": "lag", "params": {"column": "l_shipdate", "new_column": "shipped_before"}}]


def ordered_chain(s, d):
    """five ordered steps of one order: one cut, one scan of the running columns and one of the shift"""
    done = L.run_plan(t(s, d, "lineitem").select(*LINE_ORDER), CHAIN, order_by=LINE_ORDER)
    return done.df.select("row_num", "l_orderkey", "quantity_so_far", "l_extendedprice_cummax", "l_discount_cumcount", "shipped_before")


def record_of_run(s, d):
    """rows, columns and success of each step, counted within the job of the plan"""
    steps = [{"op": "filter_rows", "params": {"conditions": [{"column": "o_orderstatus", "operator": "ne", "value": "P"}]}}, {"op": "remove_duplicates", "params": {"subset": ["o_custkey"], "keep": "first"}},
             {"op": "running_total", "params": {"column": "o_totalprice", "new_column": "total"}}]
    done = L.run_plan(t(s, d, "orders"), steps, order_by=["o_orderkey"], observe=True)
    n = done.df.agg(F.count(F.lit(1)).alias("n"), F.max("total").alias("m")).first()["n"]
    return s.createDataFrame([(r["step"], r["op"], r["rows"], r["columns"], r["ms"] > 0, n) for r in done.record()], "step int, op string, rows long, columns int, timed boolean, left long")


def own_operator(s, d):
    """an operator that the user adds, in a saved step list"""
    L.register_op("discounted", lambda df, least=0.0, name="net": df.where(F.col("l_discount") >= least).withColumn(name, F.bround(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4)))
    steps = [{"op": "discounted", "params": {"least": 0.05}}, {"op": "aggregate", "params": {"group_by": "l_returnflag", "aggregations": {"net": ["sum", "count"]}}}]
    return L.run_plan(t(s, d, "lineitem"), steps).df.selectExpr("l_returnflag", "bround(net_sum, 2) AS net_sum", "net_count")


def profiled_files(s, d):
    """customers in several files, each with a total row and a blank row below; profiled without those"""
    folder = shared_folder(s)
    c = t(s, d, "customer")
    lines = c.selectExpr("c_nationkey % 3 AS f", "1 AS part", "c_custkey AS at", "concat_ws(';', c_custkey, c_name, c_nationkey, c_mktsegment) AS line")
    heads = s.range(3).selectExpr("id AS f", "0 AS part", "0L AS at", "'c_custkey;c_name;c_nationkey;c_mktsegment' AS line")
    ends = s.range(3).selectExpr("id AS f", "2 AS part", "0L AS at", "'Total;;9;' AS line").unionByName(s.range(3).selectExpr("id AS f", "2 AS part", "1L AS at", "';;;' AS line"))
    every = heads.unionByName(lines.withColumn("f", F.col("f").cast("long"))).unionByName(ends)
    every.repartition(3, "f").sortWithinPartitions("f", "part", "at").select("f", "line").write.partitionBy("f").text(folder)
    return M.profile_files(s, [f"{folder}/f={i}" for i in range(3)]).select("position", "column", "dtype", "semantic_type", "row_count", "null_count", "unique_count", "is_unique", "edge_whitespace_count")


Q = {
    "run_plan_ordered_chain": (
        ordered_chain,
        f"""SELECT row_number() OVER w AS row_num, l_orderkey, sum(l_quantity) OVER w AS quantity_so_far, max(l_extendedprice) OVER w AS l_extendedprice_cummax, count(l_discount) OVER w AS l_discount_cumcount,
            lag(l_shipdate) OVER (ORDER BY {", ".join(LINE_ORDER)}) AS shipped_before FROM lineitem WINDOW w AS (ORDER BY {", ".join(LINE_ORDER)} ROWS UNBOUNDED PRECEDING)"""),
    "run_plan_record": (
        record_of_run,
        """WITH k AS (SELECT count(*) AS n, count(DISTINCT o_custkey) AS c FROM orders WHERE o_orderstatus <> 'P')
           SELECT 1::INTEGER AS step, 'filter_rows' AS op, n AS rows, 6::INTEGER AS columns, true AS timed, c AS left FROM k UNION ALL SELECT 2, 'remove_duplicates', c, 6, true, c FROM k UNION ALL SELECT 3, 'running_total', c, 7, true, c FROM k"""),
    "register_op": (
        own_operator,
        "SELECT l_returnflag, round_even(sum(round_even(l_extendedprice * (1 - l_discount), 4)), 2) AS net_sum, count(*) AS net_count FROM lineitem WHERE l_discount >= 0.05 GROUP BY 1"),
    "profile_files": (
        profiled_files,
        " UNION ALL ".join(f"""SELECT {i}::INTEGER AS position, '{c}' AS "column", 'object' AS dtype, '{k}' AS semantic_type, count(*) AS row_count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count,
          count(DISTINCT {c}) = count(*) AS is_unique, 0::BIGINT AS edge_whitespace_count FROM customer""" for i, (c, k) in enumerate((("c_custkey", "phone"), ("c_name", "name"), ("c_nationkey", "unknown"), ("c_mktsegment", "category"))))),
    "stream_ordered_module": (
        ordered_arrivals,
        """SELECT c_custkey AS customer_id, n_name, round_even(sum(c_acctbal) OVER (ORDER BY c_custkey ROWS UNBOUNDED PRECEDING), 2) AS total, 2::BIGINT AS records
           FROM customer JOIN nation ON c_nationkey = n_nationkey"""),
    "run_plan_flagship": (
        lambda s, d: L.run_plan(t(s, d, "lineitem"), FLAGSHIP).df.selectExpr("l_returnflag", "l_linestatus", "revenue_sum", "revenue_mean", "l_quantity_sum", "l_orderkey_count", "CAST(place AS bigint) AS place"),
        """SELECT l_returnflag, l_linestatus, round_even(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue_sum, round_even(avg(l_extendedprice * (1 - l_discount)), 2) AS revenue_mean,
           sum(l_quantity) AS l_quantity_sum, count(l_orderkey) AS l_orderkey_count, rank() OVER (ORDER BY sum(l_extendedprice * (1 - l_discount)) DESC) AS place
           FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2"""),
    "run_plan_cleaning": (
        cleaning_run,
        """WITH b AS (SELECT c_custkey AS customer_id, split_part(c_name, '#', 2)::BIGINT AS number, split_part(c_name, '#', 1) AS kind, n_name, c_acctbal AS balance, c_nationkey AS nation_key,
             CASE WHEN c_acctbal <= 0 THEN 'debt' WHEN c_acctbal <= 5000 THEN 'low' ELSE 'high' END AS balance_bin, c_mktsegment AS segment FROM customer JOIN nation ON c_nationkey = n_nationkey),
           k AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY n_name, balance_bin ORDER BY customer_id) = 1)
           SELECT *, round_even(sum(balance) OVER (PARTITION BY n_name ORDER BY customer_id ROWS UNBOUNDED PRECEDING), 4) AS total FROM k"""),
    "run_plan_counts": (
        step_counts,
        """SELECT 1::INTEGER AS step, 'filter_rows' AS op, count(*) AS rows FROM orders WHERE o_orderstatus = 'O'
           UNION ALL SELECT 3, 'remove_duplicates', count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'O'"""),
    "run_plan_older": (
        older_run,
        """WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, rpad(split_part(o_orderpriority, '-', -1), 15, '.') AS priority, year(o_orderdate)::INTEGER AS o_orderdate_year
             FROM orders WHERE o_orderstatus <> 'P')
           SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) > 1 AS is_duplicate, max(o_totalprice) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS o_totalprice_cummax FROM o"""),
    "detect_header": (header_of_table, "SELECT o_orderkey::VARCHAR AS order_id, o_orderstatus AS status, o_custkey::VARCHAR AS customer FROM orders"),
    "step_metrics": (
        findings,
        "SELECT o_orderstatus AS value, 'new' AS kind, count(*) AS count FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1 UNION ALL SELECT 'q', 'missing', 0"),
    "step_effect": (
        lambda s, d: L.effect(t(s, d, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderstatus = 'F' THEN 'soon' ELSE date_format(o_orderdate, 'M/d/yyyy') END AS day"),
                              {"op": "format_date", "params": {"column": "day", "output_format": "%m/%d/%Y"}}),
        """SELECT 'day' AS "column", count(*) AS rows_after, count(*) FILTER (o_orderstatus = 'F' OR month(o_orderdate) < 10 OR day(o_orderdate) < 10) AS changed,
           count(*) FILTER (o_orderstatus = 'F') AS new_nulls FROM orders"""),
    "custom_sql": (
        lambda s, d: L.custom(t(s, d, "orders"), "SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS top FROM {df} GROUP BY o_orderstatus"),
        "SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1"),
    "run_module": (
        module_run,
        "SELECT upper(left(c_mktsegment, 1)) || lower(c_mktsegment[2:]) AS segment, round_even(sum(c_acctbal), 4) AS balance_sum, count(c_acctbal) AS balance_count FROM customer GROUP BY 1"),
    "run_module_gate": (
        module_gate,
        """SELECT f AS file, 'customers' AS contract_id, l AS level, x AS status FROM (VALUES ('good', 'HIGH', 'success'), ('bad', 'NO_MATCH', 'failed')) v(f, l, x) WHERE (SELECT count(*) FROM customer) > 0"""),
    "version_history": (
        version_history,
        """SELECT 'v1' AS id, NULL AS parent_id, count(*) AS row_count, 5::INTEGER AS column_count, 'upload' AS description, 3::BIGINT AS level FROM customer
           UNION ALL SELECT 'v2', 'v1', count(*), 5, 'solvent', 2 FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT 'v3', 'v2', count(*), 4, 'no balance', 1 FROM customer WHERE c_acctbal >= 0"""),
    "version_profile_appended": (appended_profile, " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS row_count, count(*) - count(c) AS null_count, CASE WHEN count(DISTINCT c) <= 3500 THEN count(DISTINCT c) END AS unique_count,
              {f"min(c)::DOUBLE AS min_value, max(c)::DOUBLE AS max_value, round(avg(c::DOUBLE), 4) AS mean, round(stddev_samp(c::DOUBLE), 4) AS std" if number else "NULL::DOUBLE AS min_value, NULL::DOUBLE AS max_value, NULL::DOUBLE AS mean, NULL::DOUBLE AS std"}
            FROM (SELECT {f"nullif({c}, 'P')" if c == "o_orderstatus" else c} AS c FROM orders)"""
        for c, number in (("o_orderkey", True), ("o_custkey", True), ("o_orderstatus", False), ("o_totalprice", True), ("o_orderdate", False), ("o_orderpriority", False)))),
    "version_append": (appended_rows, "SELECT * FROM customer"),
    "version_undo": (version_undo, "SELECT * FROM customer"),
    "version_lineage": (
        order_chain,
        """WITH RECURSIVE n AS (SELECT o_orderkey::VARCHAR AS id, (lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::VARCHAR AS parent_id, o_totalprice FROM orders),
           c AS (SELECT *, 1::BIGINT AS level FROM n WHERE id = (SELECT max(o_orderkey)::VARCHAR FROM orders) UNION ALL SELECT n.*, c.level + 1 FROM n JOIN c ON n.id = c.parent_id WHERE c.level < 4)
           SELECT * FROM c"""),
    "read_mixed_files": (
        mixed_files,
        """SELECT c_custkey::VARCHAR AS key, c_name || ', Inc' AS name, c_acctbal::VARCHAR AS balance, NULL AS nation FROM customer
           UNION ALL SELECT s_suppkey::VARCHAR, s_name, s_acctbal::VARCHAR, s_nationkey::VARCHAR FROM supplier"""),
    "sniff_files": (
        sniffed,
        """SELECT 'utf-8' AS encoding, e AS delimiter, 0::INTEGER AS header_row, f AS fields FROM (VALUES ('|', 'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority'),
           (chr(9), 's_suppkey,s_name,s_nationkey,s_acctbal')) v(e, f) WHERE (SELECT count(*) FROM orders) > 0"""),
    "detect_header_row": (header_rows, "SELECT 0::INTEGER AS header_row, 1.0::DOUBLE AS confidence, count(*) + 1 AS lines FROM customer"),
    "detect_footer_rows": (
        footers,
        "SELECT DISTINCT l_orderkey AS file, CASE WHEN l_orderkey % 2 = 0 THEN 2 ELSE 1 END::INTEGER AS footer_rows, 'summary' AS footer_type FROM lineitem"),
    "export_json": (exported, "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 500"),
    "csv_round_trip": (csv_round_trip, "SELECT doc_id, lang, source FROM documents"),
    "stream_module_run": (
        arrivals,
        """WITH a AS (SELECT upper(left(c_mktsegment, 1)) || lower(c_mktsegment[2:]) AS segment, round_even(sum(c_acctbal), 4) AS balance_sum, count(c_acctbal) AS balance_count FROM customer GROUP BY 1)
           SELECT * FROM a UNION ALL SELECT * FROM a"""),
}
