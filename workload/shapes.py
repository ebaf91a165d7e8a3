"""Grouping, reshaping and multi-table operators."""

from pyspark.sql import functions as F

from cleanloom.operators import groups as G, rows as R, tables as J

from .base import GAPPY, GAPPY_ORDERS, gappy_events, gappy_orders, t


def rounded(df):
    return df.withColumns({c: F.bround(c, 2) for c, k in df.dtypes if k == "double"})


def left_side(s, d):
    return t(s, d, "nation").selectExpr("CASE n_regionkey WHEN 0 THEN 'MACHINERY' WHEN 1 THEN 'FURNITURE' WHEN 2 THEN 'NONE' END AS seg", "n_nationkey", "CAST(n_regionkey AS double) AS amount")


LEFT = "(SELECT CASE n_regionkey WHEN 0 THEN 'MACHINERY' WHEN 1 THEN 'FURNITURE' WHEN 2 THEN 'NONE' END AS seg, n_nationkey, n_regionkey::DOUBLE AS amount FROM nation)"
JOINED = "coalesce(l.seg, r.seg) AS seg, n_nationkey, l.amount AS amount_left, c_custkey, r.amount AS amount_right"
RIGHT_ALL = "(SELECT nullif(c_mktsegment, 'BUILDING') AS seg, c_custkey, c_acctbal AS amount FROM customer)"


def all_customers(s, d):
    return t(s, d, "customer").selectExpr("nullif(c_mktsegment, 'BUILDING') AS seg", "c_custkey", "c_acctbal AS amount")


Q = {
    "aggregate": (
        lambda s, d: G.aggregate(t(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], {
            "l_quantity": ["sum", "mean", "min", "max"], "l_extendedprice": ["std", "var", "median"], "l_partkey": ["nunique", "count"]}).selectExpr(
            "l_returnflag", "l_linestatus", "l_quantity_sum", "bround(l_quantity_mean, 4) AS l_quantity_mean", "l_quantity_min", "l_quantity_max",
            "bround(l_extendedprice_std, 2) AS l_extendedprice_std", "bround(l_extendedprice_var, 0) AS l_extendedprice_var",
            "bround(l_extendedprice_median, 4) AS l_extendedprice_median", "l_partkey_nunique", "l_partkey_count"),
        """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS l_quantity_sum, round_even(avg(l_quantity), 4) AS l_quantity_mean, min(l_quantity) AS l_quantity_min,
           max(l_quantity) AS l_quantity_max, round_even(stddev_samp(l_extendedprice), 2) AS l_extendedprice_std, round_even(var_samp(l_extendedprice), 0) AS l_extendedprice_var,
           round_even(quantile_cont(l_extendedprice, 0.5), 4) AS l_extendedprice_median, count(DISTINCT l_partkey) AS l_partkey_nunique, count(l_partkey) AS l_partkey_count
           FROM lineitem GROUP BY 1, 2"""),
    "aggregate_null_keys": (
        lambda s, d: G.aggregate(gappy_orders(s, d), "o_orderstatus", {"o_orderkey": "first", "o_totalprice": "last", "o_custkey": "max"}, order_by=["o_orderdate", "o_orderkey"]),
        f"""SELECT o_orderstatus, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice, max(o_custkey) AS o_custkey
            FROM {GAPPY_ORDERS} WHERE o_orderstatus IS NOT NULL GROUP BY 1"""),
    "aggregate_all_null_sum": (
        lambda s, d: G.aggregate(gappy_events(s, d), ["user_id", "event_type"], {"value": "sum", "event_id": "size"}).selectExpr("user_id", "event_type", "bround(value, 4) AS value", "event_id"),
        f"SELECT user_id, event_type, round_even(coalesce(sum(value), 0), 4) AS value, count(*) AS event_id FROM {GAPPY} GROUP BY 1, 2"),
    "aggregate_mode_quantile": (
        lambda s, d: G.aggregate(t(s, d, "part"), "p_brand", {"p_size": ["mode", "quantile:0.9"]}).selectExpr("p_brand", "p_size_mode", "bround(`p_size_quantile:0.9`, 4) AS p90"),
        """SELECT p_brand, (list(p_size ORDER BY n DESC, p_size))[1] AS p_size_mode, any_value(p90) AS p90 FROM (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2)
           JOIN (SELECT p_brand, round_even(quantile_cont(p_size::DOUBLE, 0.9), 4) AS p90 FROM part GROUP BY 1) USING (p_brand) GROUP BY 1"""),
    "aggregate_value_functions": (
        lambda s, d: G.aggregate(t(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], {"l_quantity": ["median", "mode", "quantile:0.9"], "l_extendedprice": ["median", "nunique"], "l_shipdate": ["mode"]}).selectExpr(
            "l_returnflag", "l_linestatus", "l_quantity_median", "l_quantity_mode", "bround(`l_quantity_quantile:0.9`, 4) AS p90", "bround(l_extendedprice_median, 4) AS price_median", "l_extendedprice_nunique", "l_shipdate_mode"),
        """WITH m AS (SELECT l_returnflag, l_linestatus, l_quantity AS q FROM lineitem GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY count(*) DESC, q) = 1),
             n AS (SELECT l_returnflag, l_linestatus, l_shipdate AS s FROM lineitem GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY count(*) DESC, s) = 1)
           SELECT l_returnflag, l_linestatus, quantile_cont(l_quantity, 0.5) AS l_quantity_median, any_value(q) AS l_quantity_mode, round_even(quantile_cont(l_quantity, 0.9), 4) AS p90,
             round_even(quantile_cont(l_extendedprice, 0.5), 4) AS price_median, count(DISTINCT l_extendedprice) AS l_extendedprice_nunique, any_value(s) AS l_shipdate_mode
           FROM lineitem JOIN m USING (l_returnflag, l_linestatus) JOIN n USING (l_returnflag, l_linestatus) GROUP BY 1, 2"""),
    "aggregate_product": (
        lambda s, d: G.aggregate(t(s, d, "lineitem").selectExpr("l_orderkey", "1 + l_discount AS factor"), "l_orderkey", {"factor": "prod"}).selectExpr("l_orderkey", "bround(factor, 6) AS factor"),
        "SELECT l_orderkey, round_even(product(1 + l_discount), 6) AS factor FROM lineitem GROUP BY 1"),
    "concat_parts": (
        lambda s, d: R.concat_parts(gappy_orders(s, d), ["o_orderpriority"], "o_orderstatus", ["o_orderkey"], 900),
        f"""WITH r AS (SELECT o_orderpriority, o_orderstatus, o_orderkey, sum(length(o_orderstatus) + 2) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - length(o_orderstatus) - 2 AS b FROM {GAPPY_ORDERS} WHERE o_orderstatus IS NOT NULL)
            SELECT o_orderpriority, (b // 900)::BIGINT AS part, string_agg(o_orderstatus, ', ' ORDER BY o_orderkey) AS text FROM r GROUP BY 1, 2"""),
    **{f"pivot_{fn}": (
        lambda s, d, fn=fn: rounded(G.pivot(t(s, d, "orders").select("o_orderpriority", "o_orderstatus", "o_totalprice", "o_orderkey"), "o_orderpriority", "o_orderstatus", "o_totalprice", fn, None, order_by=["o_orderkey"])),
        "SELECT o_orderpriority, " + ", ".join(f"round_even({sql} FILTER (o_orderstatus = '{x}'), 2)::DOUBLE AS {x}" if fn != "nunique" else f"{sql} FILTER (o_orderstatus = '{x}') AS {x}" for x in "FOP") + " FROM orders GROUP BY 1")
       for fn, sql in (("mean", "avg(o_totalprice)"), ("min", "min(o_totalprice)"), ("max", "max(o_totalprice)"), ("last", "arg_max(o_totalprice, o_orderkey)"), ("std", "stddev_samp(o_totalprice)"),
                             ("nunique", "count(DISTINCT o_totalprice)"), ("median", "quantile_cont(o_totalprice, 0.5)"))},
    "aggregate_concat": (
        lambda s, d: G.aggregate(gappy_orders(s, d), "o_custkey", {"o_orderstatus": "concat"}, order_by=["o_orderkey"]),
        f"SELECT o_custkey, coalesce(string_agg(o_orderstatus, ', ' ORDER BY o_orderkey), '') AS o_orderstatus FROM {GAPPY_ORDERS} GROUP BY 1"),
    "group_by_count_all": (
        lambda s, d: G.group_by(gappy_orders(s, d), ["o_orderpriority"]),
        f"""SELECT o_orderpriority, count(o_orderkey) AS o_orderkey, count(o_custkey) AS o_custkey, count(o_orderstatus) AS o_orderstatus, count(o_totalprice) AS o_totalprice,
            count(o_orderdate) AS o_orderdate FROM {GAPPY_ORDERS} GROUP BY 1"""),
    "pivot_sum": (
        lambda s, d: G.pivot(t(s, d, "orders"), "o_orderpriority", "o_orderstatus", "o_totalprice").selectExpr("o_orderpriority", "bround(F, 2) AS F", "bround(O, 2) AS O", "bround(P, 2) AS P"),
        """SELECT o_orderpriority, round_even(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS F, round_even(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS O,
           round_even(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 2) AS P FROM orders GROUP BY 1"""),
    "pivot_count_two_values": (
        lambda s, d: G.pivot(gappy_events(s, d), "user_id", "event_type", ["value", "event_id"], "count", pivot_values=["click", "error"]),
        f"""SELECT user_id, count(value) FILTER (event_type = 'click') AS value_click, count(value) FILTER (event_type = 'error') AS value_error,
            count(event_id) FILTER (event_type = 'click') AS event_id_click, count(event_id) FILTER (event_type = 'error') AS event_id_error FROM {GAPPY} GROUP BY 1"""),
    "pivot_first": (
        lambda s, d: G.pivot(t(s, d, "events"), "user_id", "event_type", "event_id", "first", None, order_by=["ts", "event_id"]),
        """SELECT user_id, arg_min(event_id, (ts, event_id)) FILTER (event_type = 'click') AS click, arg_min(event_id, (ts, event_id)) FILTER (event_type = 'error') AS error,
           arg_min(event_id, (ts, event_id)) FILTER (event_type = 'purchase') AS purchase, arg_min(event_id, (ts, event_id)) FILTER (event_type = 'signup') AS signup,
           arg_min(event_id, (ts, event_id)) FILTER (event_type = 'view') AS view FROM events GROUP BY 1"""),
    "unpivot": (
        lambda s, d: G.unpivot(t(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_discount", "l_linenumber"), ["l_orderkey", "l_partkey"]),
        """SELECT l_orderkey, l_partkey, 'l_quantity' AS variable, l_quantity AS value FROM lineitem UNION ALL SELECT l_orderkey, l_partkey, 'l_discount', l_discount FROM lineitem
           UNION ALL SELECT l_orderkey, l_partkey, 'l_linenumber', l_linenumber::DOUBLE FROM lineitem"""),
    "melt_without_ids": (
        lambda s, d: G.unpivot(t(s, d, "orders").select("o_orderstatus", "o_orderpriority"), None, None, "col", "val"),
        "SELECT 'o_orderstatus' AS col, o_orderstatus AS val FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders"),
    "transpose": (
        lambda s, d: G.transpose(t(s, d, "nation").select("n_name", "n_nationkey", "n_regionkey"), use_first_column_as_header=True),
        "\nUNION ALL\n".join("SELECT '" + c + "' AS \"column\", " + ", ".join(f"max({c}) FILTER (n_name = 'NATION_{i}')::VARCHAR AS NATION_{i}" for i in range(25)) + " FROM nation"
                            for c in ("n_nationkey", "n_regionkey"))),
    "transpose_summary": (
        lambda s, d: G.transpose(G.aggregate(t(s, d, "orders"), "o_orderstatus", {"o_orderkey": "count", "o_custkey": "max"}), "o_orderstatus"),
        """SELECT 'o_orderkey' AS "column", count(*) FILTER (o_orderstatus = 'F')::VARCHAR AS F, count(*) FILTER (o_orderstatus = 'O')::VARCHAR AS O, count(*) FILTER (o_orderstatus = 'P')::VARCHAR AS P FROM orders
           UNION ALL SELECT 'o_custkey', max(o_custkey) FILTER (o_orderstatus = 'F')::VARCHAR, max(o_custkey) FILTER (o_orderstatus = 'O')::VARCHAR, max(o_custkey) FILTER (o_orderstatus = 'P')::VARCHAR FROM orders"""),
    "transpose_long": (
        lambda s, d: G.transpose_long(t(s, d, "supplier").selectExpr("s_suppkey", "s_name", "CAST(s_nationkey AS string) AS s_nationkey"), "s_suppkey"),
        """SELECT s_suppkey, 's_name' AS "column", s_name AS value FROM supplier UNION ALL SELECT s_suppkey, 's_nationkey', s_nationkey::VARCHAR FROM supplier"""),
    "join_inner": (
        lambda s, d: J.join_tables(t(s, d, "orders"), t(s, d, "customer"), "o_custkey", "c_custkey", "inner"),
        "SELECT * FROM orders JOIN customer ON o_custkey = c_custkey"),
    "join_left_null_keys": (
        lambda s, d: J.join_tables(left_side(s, d), all_customers(s, d), "seg", how="left"),
        f"SELECT {JOINED} FROM {LEFT} l LEFT JOIN {RIGHT_ALL} r ON l.seg IS NOT DISTINCT FROM r.seg"),
    "join_right": (
        lambda s, d: J.join_tables(left_side(s, d), all_customers(s, d), "seg", how="right"),
        f"SELECT {JOINED} FROM {LEFT} l RIGHT JOIN {RIGHT_ALL} r ON l.seg IS NOT DISTINCT FROM r.seg"),
    "join_outer": (
        lambda s, d: J.join_tables(left_side(s, d), all_customers(s, d), "seg", how="outer"),
        f"SELECT {JOINED} FROM {LEFT} l FULL JOIN {RIGHT_ALL} r ON l.seg IS NOT DISTINCT FROM r.seg"),
    "join_two_keys": (
        lambda s, d: J.join(t(s, d, "lineitem").selectExpr("l_orderkey", "l_partkey AS k1", "l_suppkey AS k2", "l_tax AS v"),
                            t(s, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg({"l_quantity": "max"}).toDF("k1", "k2", "v"), ["k1", "k2"]),
        """SELECT l_orderkey, l_partkey AS k1, l_suppkey AS k2, l_tax AS v, r.v AS v_right FROM lineitem
           LEFT JOIN (SELECT l_partkey AS k1, l_suppkey AS k2, max(l_quantity) AS v FROM lineitem GROUP BY 1, 2) r ON l_partkey = r.k1 AND l_suppkey = r.k2"""),
    "union_common": (
        lambda s, d: J.union_tables(t(s, d, "customer").selectExpr("c_custkey AS key", "c_name AS name", "c_mktsegment"), [t(s, d, "supplier").selectExpr("s_name AS name", "s_suppkey AS key", "s_acctbal")]),
        "SELECT c_custkey AS key, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier"),
    "union_all_columns": (
        lambda s, d: J.union_tables(t(s, d, "customer").selectExpr("c_custkey AS key", "c_name AS name", "c_mktsegment"), t(s, d, "supplier").selectExpr("s_name AS name", "s_suppkey AS key", "s_acctbal"), match_columns=False),
        "SELECT c_custkey AS key, c_name AS name, c_mktsegment, NULL::DOUBLE AS s_acctbal FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier"),
    "lookup": (
        lambda s, d: J.lookup(t(s, d, "customer").withColumn("c_nationkey", F.expr("nullif(c_nationkey, 3)")), t(s, d, "nation"), "c_nationkey", "n_nationkey", ["n_name", "n_regionkey"], "unknown"),
        """SELECT c.* REPLACE (nullif(c_nationkey, 3) AS c_nationkey), coalesce(n_name, 'unknown') AS n_name, n_regionkey FROM customer c LEFT JOIN nation ON nullif(c_nationkey, 3) = n_nationkey"""),
    "lookup_first_match": (
        lambda s, d: J.lookup(t(s, d, "customer").select("c_custkey", "c_name"), gappy_orders(s, d), "c_custkey", "o_custkey", ["o_orderkey", "o_orderstatus"], None, ["o_orderdate", "o_orderkey"]),
        f"""SELECT c_custkey, c_name, o_orderkey, o_orderstatus FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey, o_orderstatus FROM {GAPPY_ORDERS}
            QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1) ON c_custkey = o_custkey"""),
}
