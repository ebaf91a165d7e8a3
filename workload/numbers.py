"""Numeric, conditional, rank and window operators."""

from cleanloom.operators import calculate as K

from .base import GAPPY, GAPPY_ORDERS, LINE_BY, LINE_ORDER, gappy_events, gappy_orders, t


def r4(df, *cols):
    return df.selectExpr(*[f"bround({c}, 4) AS {c}" if c in cols else c for c in df.columns])


Q = {
    "math_multiply": (
        lambda s, d: r4(K.math_operation(t(s, d, "lineitem"), "cost", "multiply", "l_quantity", "l_extendedprice").select("l_orderkey", "l_partkey", "cost"), "cost"),
        "SELECT l_orderkey, l_partkey, round_even(l_quantity * l_extendedprice, 4) AS cost FROM lineitem"),
    "math_divide_zero": (
        lambda s, d: r4(K.math_operation(t(s, d, "lineitem"), "ratio", "divide", "l_quantity", "l_tax").select("l_orderkey", "l_partkey", "l_quantity", "ratio"), "ratio"),
        "SELECT l_orderkey, l_partkey, l_quantity, round_even(CASE WHEN l_tax <> 0 THEN l_quantity / l_tax END, 4) AS ratio FROM lineitem"),
    "math_text_cells": (
        lambda s, d: K.math_operation(t(s, d, "events").selectExpr("event_id", "CASE WHEN event_type = 'error' THEN 'bad' ELSE CAST(user_id AS string) END AS x"), "y", "add", "x", value=10),
        "SELECT event_id, CASE WHEN event_type = 'error' THEN 'bad' ELSE user_id::VARCHAR END AS x, CASE WHEN event_type <> 'error' THEN user_id + 10.0::DOUBLE END AS y FROM events"),
    "round_numbers": (
        lambda s, d: K.round_numbers(t(s, d, "events").selectExpr("event_id", "event_id / 8.0D AS x"), "x", 1), "SELECT event_id, round_even(event_id / 8.0::DOUBLE, 1) AS x FROM events"),
    "round_floor": (
        lambda s, d: K.round_numbers(t(s, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", -2, "floor"),
        "SELECT c_custkey, floor(c_acctbal / 100.0) * 100.0 AS c_acctbal FROM customer"),
    "floor_ceil": (
        lambda s, d: K.floor_ceil(t(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice"), "l_extendedprice", "ceil", 1),
        "SELECT l_orderkey, l_partkey, ceil(l_extendedprice * 10.0) / 10.0 AS l_extendedprice FROM lineitem"),
    "floor_ceiling_columns": (
        lambda s, d: K.floor_ceil(t(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_discount", "l_extendedprice"), ["l_discount", "l_extendedprice"], "floor"),
        "SELECT l_orderkey, l_partkey, floor(l_discount) AS l_discount, floor(l_extendedprice) AS l_extendedprice FROM lineitem"),
    "percentage_of_total": (
        lambda s, d: r4(K.percentage(t(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "pct"), "pct"),
        "SELECT o_orderkey, o_totalprice, round_even(o_totalprice / (SELECT sum(o_totalprice) FROM orders) * 100, 4) AS pct FROM orders"),
    "percentage_of_column": (
        lambda s, d: r4(K.percentage(t(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_tax", "l_discount"), "l_discount", "pct", "of_column", "l_tax", False), "pct"),
        "SELECT l_orderkey, l_partkey, l_tax, l_discount, round_even(CASE WHEN l_tax <> 0 THEN l_discount / l_tax END, 4) AS pct FROM lineitem"),
    "percent_of_total_grouped": (
        lambda s, d: K.percent_of_total(t(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), ["o_totalprice"], "o_orderstatus", decimal_places=3),
        "SELECT o_orderkey, o_orderstatus, o_totalprice, round_even(100 * (o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_orderstatus)), 3) AS o_totalprice_pct FROM orders"),
    "running_total": (
        lambda s, d: r4(K.running_total(gappy_events(s, d).select("event_id", "value"), "value", "total", order_by=["event_id"]), "total"),
        f"SELECT event_id, value, round_even(CASE WHEN value IS NOT NULL THEN sum(value) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) END, 4) AS total FROM {GAPPY}"),
    "running_total_grouped": (
        lambda s, d: r4(K.running_total(gappy_orders(s, d).select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_totalprice", "total", "o_orderstatus", order_by=["o_orderkey"]), "total"),
        f"""SELECT o_orderkey, o_orderstatus, o_totalprice, round_even(CASE WHEN o_orderstatus IS NOT NULL THEN
            sum(o_totalprice) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) END, 4) AS total FROM {GAPPY_ORDERS}"""),
    "running_total_lineitem": (
        lambda s, d: K.running_total(t(s, d, "lineitem"), "l_quantity", "total", order_by=LINE_ORDER).select("l_orderkey", "l_linenumber", "l_extendedprice", "total"),
        f"SELECT l_orderkey, l_linenumber, l_extendedprice, sum(l_quantity) OVER (ORDER BY {LINE_BY} ROWS UNBOUNDED PRECEDING) AS total FROM lineitem"),
    "rank_dense": (
        lambda s, d: K.rank(t(s, d, "part"), "p_size", "r").selectExpr("p_partkey", "p_size", "CAST(r AS bigint) AS r"),
        "SELECT p_partkey, p_size, dense_rank() OVER (ORDER BY p_size) AS r FROM part"),
    "rank_min_desc_grouped": (
        lambda s, d: K.rank(t(s, d, "part"), "p_size", "r", False, "min", "p_type").selectExpr("p_partkey", "p_type", "p_size", "CAST(r AS bigint) AS r"),
        "SELECT p_partkey, p_type, p_size, rank() OVER (PARTITION BY p_type ORDER BY p_size DESC) AS r FROM part"),
    "rank_max": (
        lambda s, d: K.rank(gappy_events(s, d), "value", "r", True, "max").selectExpr("event_id", "value", "CAST(r AS bigint) AS r"),
        f"SELECT event_id, value, CASE WHEN value IS NOT NULL THEN rank() OVER (ORDER BY value NULLS LAST) + count(*) OVER (PARTITION BY value) - 1 END AS r FROM {GAPPY}"),
    "rank_average": (
        lambda s, d: K.rank_values(t(s, d, "part").select("p_partkey", "p_size"), ["p_size"]),
        "SELECT p_partkey, p_size, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0::DOUBLE AS p_size_rank FROM part"),
    "rank_first": (
        lambda s, d: K.rank(t(s, d, "part"), "p_size", "r", True, "first", order_by=["p_partkey"]).select("p_partkey", "p_size", "r"),
        "SELECT p_partkey, p_size, row_number() OVER (ORDER BY p_size, p_partkey) AS r FROM part"),
    "dense_rank_partitioned": (
        lambda s, d: K.dense_rank(t(s, d, "part"), "p_retailprice", "r", False, ["p_brand"]).selectExpr("p_partkey", "p_brand", "CAST(r AS bigint) AS r"),
        "SELECT p_partkey, p_brand, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) AS r FROM part"),
    "percent_rank": (
        lambda s, d: r4(K.percent_rank(gappy_events(s, d).select("event_id", "value"), "value", "p"), "p"),
        f"SELECT event_id, value, round_even(CASE WHEN value IS NOT NULL THEN rank() OVER (ORDER BY value NULLS LAST) / count(value) OVER ()::DOUBLE END, 4) AS p FROM {GAPPY}"),
    "percent_rank_grouped": (
        lambda s, d: r4(K.percent_rank(t(s, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), "c_acctbal", "p", False, ["c_nationkey"]), "p"),
        "SELECT c_custkey, c_nationkey, c_acctbal, round_even(rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) / count(*) OVER (PARTITION BY c_nationkey)::DOUBLE, 4) AS p FROM customer"),
    "percent_rank_sql": (
        lambda s, d: r4(K.percent_rank(t(s, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "p", sql=True), "p"),
        "SELECT c_custkey, c_acctbal, round_even(percent_rank() OVER (ORDER BY c_acctbal), 4) AS p FROM customer"),
    "ntile": (
        lambda s, d: K.ntile(t(s, d, "customer").select("c_custkey", "c_acctbal"), 7, "c_acctbal", "bucket", tie_break=["c_custkey"]),
        "SELECT c_custkey, c_acctbal, ((row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1) * 7 // count(*) OVER ()) + 1 AS bucket FROM customer"),
    "ntile_grouped": (
        lambda s, d: K.ntile(t(s, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), 4, "c_acctbal", "bucket", False, ["c_nationkey"], tie_break=["c_custkey"]),
        """SELECT c_custkey, c_nationkey, c_acctbal, ((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) - 1) * 4
           // count(*) OVER (PARTITION BY c_nationkey)) + 1 AS bucket FROM customer"""),
    "ntile_sql": (
        lambda s, d: K.ntile(t(s, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), 4, "c_acctbal", "bucket", True, ["c_nationkey"], True, ["c_custkey"]),
        "SELECT c_custkey, c_nationkey, c_acctbal, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS bucket FROM customer"),
    "conditional_value": (
        lambda s, d: K.conditional_value(gappy_orders(s, d), "size", [
            {"column": "o_orderstatus", "operator": "isnull", "value": "none"}, {"column": "o_totalprice", "operator": "gte", "compare_value": 400000, "value": "big"},
            {"column": "o_orderpriority", "operator": "contains", "compare_value": "LOW", "value": "low"}, {"column": "o_totalprice", "operator": "sounds like", "value": "x"}], "rest"),
        f"""SELECT *, CASE WHEN o_orderstatus IS NULL THEN 'none' WHEN o_totalprice >= 400000 THEN 'big' WHEN contains(o_orderpriority, 'LOW') THEN 'low'
            ELSE 'rest' END AS size FROM {GAPPY_ORDERS}"""),
    "case_when": (
        lambda s, d: K.case_when(t(s, d, "orders"), [
            {"condition": {"column": "o_orderpriority", "operator": "contains", "value": "urgent"}, "result": 3},
            {"condition": {"column": "o_orderstatus", "operator": "in", "value": ["O", "F"]}, "result": 2},
            {"condition": {"column": "o_totalprice", "operator": "lt", "value": 50000}, "result": 1}], "level", 0),
        """SELECT *, CASE WHEN contains(lower(o_orderpriority), 'urgent') THEN 3 WHEN o_orderstatus IN ('O', 'F') THEN 2 WHEN o_totalprice < 50000 THEN 1
           ELSE 0 END::INTEGER AS level FROM orders"""),
    "conditional_replace": (
        lambda s, d: K.conditional_replace(t(s, d, "orders"), [{"condition": "o_totalprice > 400000 AND o_orderstatus = 'O'", "value": "A"},
                                                               {"condition": "year(o_orderdate) < 1996", "value": "B"}], None, "grade", "o_orderstatus"),
        "SELECT *, CASE WHEN o_totalprice > 400000 AND o_orderstatus = 'O' THEN 'A' WHEN year(o_orderdate) < 1996 THEN 'B' ELSE o_orderstatus END AS grade FROM orders"),
    "bin_values_width": (
        lambda s, d: K.bin_values(t(s, d, "part").select("p_partkey", "p_size"), "p_size", 5, "bin"),
        """WITH m AS (SELECT min(p_size)::DOUBLE AS lo, max(p_size)::DOUBLE AS hi FROM part),
           b AS (SELECT p_partkey, p_size, CASE WHEN p_size = lo THEN 0 ELSE ceil((p_size - lo) / ((hi - lo) / 5))::INTEGER - 1 END AS i, lo, hi FROM part, m)
           SELECT p_partkey, p_size, '(' || CASE WHEN i = 0 THEN round(round(lo - (hi - lo) * 0.001, 3) - 0.001, 4) ELSE round(lo + (hi - lo) / 5 * i, 3) END
             || ', ' || round(lo + (hi - lo) / 5 * (i + 1), 3) || ']' AS bin FROM b"""),
    "bin_values_edges": (
        lambda s, d: K.bin_values(t(s, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", [0, 1000, 5000, float("inf")], "band", ["low", "mid", "high"]),
        "SELECT c_custkey, c_acctbal, CASE WHEN c_acctbal >= 0 AND c_acctbal <= 1000 THEN 'low' WHEN c_acctbal > 1000 AND c_acctbal <= 5000 THEN 'mid' WHEN c_acctbal > 5000 THEN 'high' END AS band FROM customer"),
    "bin_numeric_quantile": (
        lambda s, d: K.bin_numeric(t(s, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], "quantile", 4, ["q1", "q2", "q3", "q4"]),
        """SELECT c_custkey, c_acctbal, CASE WHEN c_acctbal <= q[1] THEN 'q1' WHEN c_acctbal <= q[2] THEN 'q2' WHEN c_acctbal <= q[3] THEN 'q3' ELSE 'q4' END AS c_acctbal_bin
           FROM customer, (SELECT quantile_cont(c_acctbal, [0.25, 0.5, 0.75]) AS q FROM customer)"""),
    "absolute_value": (
        lambda s, d: K.absolute_value(t(s, d, "customer"), "c_acctbal", "debt"), "SELECT *, abs(c_acctbal) AS debt FROM customer"),
    "is_between": (
        lambda s, d: K.is_between(gappy_events(s, d), "value", 10, 20, "mid", "left"), f"SELECT *, coalesce(value >= 10 AND value < 20, false) AS mid FROM {GAPPY}"),
    "lag": (
        lambda s, d: K.lag(gappy_events(s, d), "value", "prev", 2, -1.0, order_by=["event_id"]),
        f"SELECT *, coalesce(lag(value, 2) OVER (ORDER BY event_id), -1.0::DOUBLE) AS prev FROM {GAPPY}"),
    "lag_grouped": (
        lambda s, d: K.lag(gappy_events(s, d), "event_type", "prev", 1, None, "user_id", order_by=["ts", "event_id"]),
        f"SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM {GAPPY}"),
    "lead": (
        lambda s, d: K.lead(t(s, d, "orders"), "o_totalprice", "next", 3, order_by=["o_orderdate", "o_orderkey"]),
        "SELECT *, lead(o_totalprice, 3) OVER (ORDER BY o_orderdate, o_orderkey) AS next FROM orders"),
    "lead_grouped": (
        lambda s, d: K.lead(t(s, d, "orders"), "o_orderkey", "next", 1, -1, "o_orderstatus", order_by=["o_totalprice", "o_orderkey"]),
        "SELECT *, coalesce(lead(o_orderkey) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey), -1) AS next FROM orders"),
    "lag_lead_edge_fill": (
        lambda s, d: K.lag_lead(gappy_events(s, d), ["value"], -2, suffix="_next", fill_value=0.0, order_by=["event_id"]),
        f"SELECT *, lead(value, 2, 0.0::DOUBLE) OVER (ORDER BY event_id) AS value_next FROM {GAPPY}"),
    "moving_average": (
        lambda s, d: r4(K.moving_average(gappy_events(s, d).select("event_id", "value"), "value", 4, "ma", 2, order_by=["event_id"]), "ma"),
        f"""SELECT event_id, value, round_even(CASE WHEN count(value) OVER w >= 2 THEN avg(value) OVER w END, 4) AS ma FROM {GAPPY}
            WINDOW w AS (ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"""),
    "moving_average_long": (
        lambda s, d: K.moving_average(gappy_events(s, d).select("event_id", "value"), "value", 5000, "ma", 2, order_by=["event_id"]).selectExpr("event_id", "bround(ma * 0.7234567D, 6) AS ma"),
        f"""SELECT event_id, round_even(CASE WHEN count(value) OVER w >= 2 THEN avg(value) OVER w END * 0.7234567::DOUBLE, 6) AS ma FROM {GAPPY}
            WINDOW w AS (ORDER BY event_id ROWS BETWEEN 4999 PRECEDING AND CURRENT ROW)"""),
    "lag_far": (
        lambda s, d: K.lag(t(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "earlier", 2000, order_by=["o_orderkey"]),
        "SELECT o_orderkey, o_totalprice, lag(o_totalprice, 2000) OVER (ORDER BY o_orderkey) AS earlier FROM orders"),
    "moving_average_center": (
        lambda s, d: r4(K.moving_average(gappy_events(s, d).select("event_id", "user_id", "value"), "value", 5, "ma", center=True, partition_by="user_id", order_by=["event_id"]), "ma"),
        f"""SELECT event_id, user_id, value, round_even(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 4) AS ma FROM {GAPPY}"""),
    "first_value": (
        lambda s, d: K.first_value(gappy_orders(s, d), "o_orderstatus", ["o_custkey"], "first_status", "o_orderdate", tie_break=["o_orderkey"]),
        f"""SELECT *, first_value(o_orderstatus IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
            ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_status FROM {GAPPY_ORDERS}"""),
    "cumulative_mean": (
        lambda s, d: K.cumulative(gappy_events(s, d).select("event_id", "user_id", "value"), ["value"], "mean", "user_id", order_by=["event_id"]).selectExpr(
            "event_id", "user_id", "value", "bround(value_cummean, 10) AS value_cummean"),
        f"""SELECT event_id, user_id, value, round_even(CASE WHEN value IS NOT NULL THEN avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) END, 10)
            AS value_cummean FROM {GAPPY}"""),
    "cumulative_max": (
        lambda s, d: K.cumulative(gappy_events(s, d).select("event_id", "value"), ["value"], "max", order_by=["event_id"]),
        f"SELECT event_id, value, CASE WHEN value IS NOT NULL THEN max(value) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) END AS value_cummax FROM {GAPPY}"),
    "cumulative_min_grouped": (
        lambda s, d: K.cumulative(t(s, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), ["o_totalprice"], "min", "o_orderpriority", order_by=["-o_orderkey"]),
        "SELECT o_orderkey, o_orderpriority, o_totalprice, min(o_totalprice) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey DESC ROWS UNBOUNDED PRECEDING) AS o_totalprice_cummin FROM orders"),
    "cumulative_count": (
        lambda s, d: K.cumulative(gappy_events(s, d).select("event_id", "value"), ["value"], "count", order_by=["event_id"]),
        f"SELECT event_id, value, count(value) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS value_cumcount FROM {GAPPY}"),
    "cumulative_product": (
        lambda s, d: r4(K.cumulative(t(s, d, "lineitem").selectExpr("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "1 + l_tax / 10 AS f"), ["f"], "prod", "l_suppkey",
                                     order_by=["l_orderkey", "l_linenumber", "l_extendedprice"]), "f_cumprod"),
        """SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, 1 + l_tax / 10 AS f,
           round_even(exp(sum(ln(1 + l_tax / 10)) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_extendedprice ROWS UNBOUNDED PRECEDING)), 4) AS f_cumprod FROM lineitem"""),
    "normalize_minmax": (
        lambda s, d: r4(K.normalize(t(s, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], suffix="_norm"), "c_acctbal_norm"),
        "SELECT c_custkey, c_acctbal, round_even((c_acctbal - lo) / (hi - lo), 4) AS c_acctbal_norm FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)"),
    "normalize_zscore": (
        lambda s, d: r4(K.normalize(gappy_events(s, d).select("event_id", "value"), ["value"], "zscore"), "value"),
        f"SELECT event_id, round_even((value - m) / sd, 4) AS value FROM {GAPPY}, (SELECT avg(value) AS m, stddev_samp(value) AS sd FROM {GAPPY})"),
    "outliers_cap_iqr": (
        lambda s, d: r4(K.handle_outliers(t(s, d, "events").select("event_id", "value"), ["value"]), "value"),
        """SELECT event_id, round_even(least(greatest(value, q[1] - 1.5 * (q[2] - q[1])), q[2] + 1.5 * (q[2] - q[1])), 4) AS value
           FROM events, (SELECT quantile_cont(value, [0.25, 0.75]) AS q FROM events)"""),
    "outliers_flag_zscore": (
        lambda s, d: K.handle_outliers(t(s, d, "events").select("event_id", "value"), ["value"], "flag", "zscore"),
        "SELECT event_id, value, value < m - 3 * sd OR value > m + 3 * sd AS value_outlier FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS sd FROM events)"),
    "outliers_remove_percentile": (
        lambda s, d: K.handle_outliers(t(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice"), ["l_extendedprice"], "remove", "percentile", 5, 95),
        """SELECT l_orderkey, l_partkey, l_extendedprice FROM lineitem, (SELECT quantile_cont(l_extendedprice, [0.05, 0.95]) AS q FROM lineitem)
           WHERE l_extendedprice >= q[1] AND l_extendedprice <= q[2]"""),
    "outliers_null": (
        lambda s, d: K.handle_outliers(t(s, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], "replace_null", "percentile", 10, 90),
        """SELECT o_orderkey, CASE WHEN o_totalprice >= q[1] AND o_totalprice <= q[2] THEN o_totalprice END AS o_totalprice
           FROM orders, (SELECT quantile_cont(o_totalprice, [0.1, 0.9]) AS q FROM orders)"""),
}
