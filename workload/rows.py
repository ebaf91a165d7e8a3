"""Row operators."""

from pyspark.sql import functions as F

from cleanloom.operators import rows as R

from .base import CUSTOMER_ORDERS, GAPPY, GAPPY_ORDERS, LINE_BY, LINE_ORDER, customer_orders, gappy_events, gappy_orders, t

DIRTY = "SELECT c_custkey, '  ' || c_name || '  ' AS label, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer"

def sample_facts(s, d):
    """sizes, distinct keys and subsets of seeded, unseeded and repeated samples of orders"""
    orders = t(s, d, "orders")
    one, two = (R.sample_rows(orders, n=2000, seed=7) for _ in range(2))
    drawn = R.sample_rows(orders, n=3000, seed=7, replace=True, key=["o_orderkey"])
    count = lambda df: df.agg(F.count(F.lit(1))).scalar()
    near = F.abs(count(R.sample_rows(orders, fraction=0.2, seed=7)) - 0.2 * count(orders)) <= 0.05 * count(orders) + 5
    return s.range(1).select(
        count(one).alias("n"), one.agg(F.count_distinct("o_orderkey")).scalar().alias("n_distinct"), count(one.exceptAll(orders)).alias("outside"), count(one.exceptAll(two)).alias("changed"),
        count(R.sample_rows(orders, n=1500)).alias("unseeded"), count(drawn).alias("replaced"), count(drawn.select("o_orderkey").distinct().exceptAll(orders.select("o_orderkey"))).alias("replaced_outside"),
        near.alias("fraction_near"))


Q = {
    "sort_rows": (
        lambda s, d: R.sort_rows(t(s, d, "orders"), ["o_orderpriority", "o_totalprice"], [True, False], order_by=["o_orderkey"]),
        "SELECT * FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey"),
    "filter_rows": (
        lambda s, d: R.filter_rows(t(s, d, "lineitem"), [
            {"column": "l_returnflag", "operator": "ne", "value": "r"}, {"column": "l_discount", "operator": "gte", "value": 0.05},
            {"column": "l_linestatus", "operator": "in", "value": ["o", "F"]}, {"column": "l_quantity", "operator": "lt", "value": 24}]),
        "SELECT * FROM lineitem WHERE lower(l_returnflag) <> 'r' AND l_discount >= 0.05 AND lower(l_linestatus) IN ('o','f') AND l_quantity < 24"),
    "filter_rows_or": (
        lambda s, d: R.filter_rows(t(s, d, "customer"), [
            {"column": "c_name", "operator": "endswith", "value": "7"}, {"column": "c_mktsegment", "operator": "startswith", "value": "auto"},
            {"column": "c_acctbal", "operator": "lte", "value": 0}, {"column": "c_mktsegment", "operator": "regex", "value": "MACH|FUR", "case_sensitive": True},
            {"column": "c_name", "operator": "contains", "value": "#0000001"}], "or"),
        """SELECT * FROM customer WHERE ends_with(lower(c_name), '7') OR starts_with(lower(c_mktsegment), 'auto') OR c_acctbal <= 0
           OR regexp_matches(c_mktsegment, '^(?:MACH|FUR)') OR regexp_matches(c_name, '(?i)#0000001')"""),
    "filter_rows_negated_nulls": (
        lambda s, d: R.filter_rows(gappy_orders(s, d), [{"column": "o_orderstatus", "operator": "eq", "value": "O"},
                                                        {"column": "o_totalprice", "operator": "gt", "value": 100000}], keep=False),
        f"SELECT * FROM {GAPPY_ORDERS} WHERE NOT (coalesce(lower(o_orderstatus) = 'o', false) AND o_totalprice > 100000)"),
    "filter_rows_not_in_nulls": (
        lambda s, d: R.filter_rows(gappy_orders(s, d), [{"column": "o_orderstatus", "operator": "not_in", "value": ["F"]},
                                                        {"column": "o_orderpriority", "operator": "notnull"}]),
        f"SELECT * FROM {GAPPY_ORDERS} WHERE coalesce(lower(o_orderstatus) NOT IN ('f'), true) AND o_orderpriority IS NOT NULL"),
    "filter_numeric_and_dates": (
        lambda s, d: R.filter_rows(t(s, d, "events").selectExpr("event_id", "split(props, '[{}: ]+')[2] AS k", "date_format(ts, 'MM/dd/yyyy') AS day"),
                                   [{"column": "k", "operator": "is_numeric"}, {"column": "day", "operator": "is_date"}]),
        "SELECT event_id, regexp_extract(props, '[0-9]+') AS k, strftime(ts, '%m/%d/%Y') AS day FROM events WHERE try_cast(regexp_extract(props, '[0-9]+') AS DOUBLE) IS NOT NULL"),
    "drop_rows": (
        lambda s, d: R.drop_rows(t(s, d, "orders"), conditions=[{"column": "o_orderstatus", "operator": "eq", "value": "F"}]),
        "SELECT * FROM orders WHERE o_orderstatus <> 'F'"),
    "drop_rows_blank": (
        lambda s, d: R.drop_rows(s.sql("SELECT c_custkey, c_name, CASE WHEN c_mktsegment = 'BUILDING' THEN '  ' ELSE nullif(c_mktsegment, 'MACHINERY') END AS seg FROM {c}",
                                       c=t(s, d, "customer")), ["seg"]),
        "SELECT c_custkey, c_name, c_mktsegment AS seg FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')"),
    "drop_rows_any_null": (lambda s, d: R.drop_rows(customer_orders(s, d)), f"SELECT * FROM {CUSTOMER_ORDERS} WHERE o_orderkey IS NOT NULL"),
    "limit_rows_from_end": (
        lambda s, d: R.limit_rows(t(s, d, "orders"), 100, True, order_by=["o_orderkey"]), "SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 100"),
    "head_rows": (lambda s, d: R.head_rows(t(s, d, "orders"), 25, order_by=["o_orderkey"]), "SELECT * FROM orders ORDER BY o_orderkey LIMIT 25"),
    "tail_rows": (lambda s, d: R.tail_rows(t(s, d, "orders"), order_by=["o_orderkey"]), "SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 10"),
    "slice_rows": (
        lambda s, d: R.slice_rows(t(s, d, "events"), 15, "tail", order_by=["-value", "event_id"]),
        "SELECT * FROM events ORDER BY value ASC, event_id DESC LIMIT 15"),
    "offset_rows": (
        lambda s, d: R.offset_rows(t(s, d, "orders"), 1000, order_by=["o_orderdate", "o_orderkey"]),
        "SELECT * FROM orders ORDER BY o_orderdate, o_orderkey OFFSET 1000"),
    "remove_duplicates_first": (
        lambda s, d: R.remove_duplicates(t(s, d, "events"), ["user_id", "event_type"], "first", order_by=["event_id"]),
        "SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1"),
    "remove_duplicates_last": (
        lambda s, d: R.remove_duplicates(gappy_orders(s, d), ["o_custkey", "o_orderstatus"], "last", order_by=["o_orderdate", "o_orderkey"]),
        f"SELECT * FROM {GAPPY_ORDERS} QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"),
    "remove_duplicates_none": (
        lambda s, d: R.remove_duplicates(t(s, d, "documents"), ["text"], "none"),
        "SELECT * FROM documents QUALIFY count(*) OVER (PARTITION BY text) = 1"),
    "deduplicate_rows": (
        lambda s, d: R.remove_duplicates(t(s, d, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus")),
        "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem"),
    "merge_duplicates": (
        lambda s, d: R.merge_duplicates(gappy_events(s, d), "user_id", {"value": "mean", "event_type": "concat", "ts": "max", "props": "last"},
                                        order_by=["event_id"]).selectExpr("user_id", "event_id", "ts", "event_type", "bround(value, 4) AS value", "props"),
        f"""SELECT user_id, arg_min(event_id, event_id) AS event_id, max(ts) AS ts, string_agg(event_type, ', ' ORDER BY event_id) AS event_type,
            round_even(avg(value), 4) AS value, arg_max(props, event_id) AS props FROM {GAPPY} GROUP BY user_id"""),
    "merge_duplicates_first_known": (
        lambda s, d: R.merge_duplicates(gappy_orders(s, d).select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", order_by=["o_orderkey"]),
        f"SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_orderstatus, o_orderkey) FILTER (o_orderstatus IS NOT NULL) AS o_orderstatus FROM {GAPPY_ORDERS} GROUP BY 1"),
    "fill_blanks_value": (
        lambda s, d: R.fill_blanks(gappy_orders(s, d), "o_orderstatus", "value", "?"),
        f"SELECT * REPLACE (coalesce(o_orderstatus, '?') AS o_orderstatus) FROM {GAPPY_ORDERS}"),
    "fill_blanks_mean": (
        lambda s, d: R.fill_blanks(gappy_events(s, d), "value", "mean").selectExpr("event_id", "bround(value, 4) AS value"),
        f"SELECT event_id, round_even(coalesce(value, (SELECT avg(value) FROM {GAPPY})), 4) AS value FROM {GAPPY}"),
    "fill_blanks_median": (
        lambda s, d: R.fill_blanks(gappy_events(s, d), "value", "median").selectExpr("event_id", "bround(value, 4) AS value"),
        f"SELECT event_id, round_even(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM {GAPPY})), 4) AS value FROM {GAPPY}"),
    "fill_blanks_mode": (
        lambda s, d: R.fill_blanks(gappy_orders(s, d), "o_orderstatus", "mode"),
        f"""SELECT * REPLACE (coalesce(o_orderstatus, (SELECT o_orderstatus FROM {GAPPY_ORDERS} WHERE o_orderstatus IS NOT NULL
            GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderstatus) FROM {GAPPY_ORDERS}"""),
    "fill_blanks_forward": (
        lambda s, d: R.fill_blanks(gappy_events(s, d), "value", "forward", order_by=["event_id"]),
        f"SELECT * REPLACE (last_value(value IGNORE NULLS) OVER (ORDER BY event_id) AS value) FROM {GAPPY}"),
    "fill_blanks_backward": (
        lambda s, d: R.fill_blanks(gappy_events(s, d), "value", "backward", order_by=["event_id"]),
        f"SELECT * REPLACE (first_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value) FROM {GAPPY}"),
    "fill_nulls_interpolate": (
        lambda s, d: R.fill_nulls(gappy_events(s, d), ["value"], "interpolate", order_by=["event_id"]).selectExpr("event_id", "bround(value, 4) AS value"),
        f"""WITH n AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id) AS p FROM {GAPPY}),
            k AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN p END IGNORE NULLS) OVER w AS p0, last_value(value IGNORE NULLS) OVER w AS v0,
              first_value(CASE WHEN value IS NOT NULL THEN p END IGNORE NULLS) OVER f AS p1, first_value(value IGNORE NULLS) OVER f AS v1 FROM n
              WINDOW w AS (ORDER BY event_id), f AS (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
            SELECT event_id, round_even(coalesce(value, v0 + (v1 - v0) * (p - p0) / nullif(p1 - p0, 0), v0), 4) AS value FROM k"""),
    "fill_nulls_value": (
        lambda s, d: R.fill_nulls(gappy_events(s, d).withColumn("props", F.expr("nullif(props, '{\"k\": 1}')")), ["value", "props"], "value", 0),
        f"""SELECT * REPLACE (coalesce(value, 0) AS value, nullif(props, '{{"k": 1}}') AS props) FROM {GAPPY}"""),
    "fill_nulls_mean_median": (
        lambda s, d: R.fill_nulls(R.fill_nulls(gappy_events(s, d).withColumn("other", F.col("value")), ["value"], "mean"), ["other"], "median").selectExpr("event_id", "bround(value, 4) AS value", "bround(other, 4) AS other"),
        f"""SELECT event_id, round_even(coalesce(value, (SELECT avg(value) FROM {GAPPY})), 4) AS value, round_even(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM {GAPPY})), 4) AS other FROM {GAPPY}"""),
    "fill_nulls_mode": (
        lambda s, d: R.fill_nulls(gappy_orders(s, d), ["o_orderstatus"], "mode"),
        f"""SELECT * REPLACE (coalesce(o_orderstatus, (SELECT o_orderstatus FROM {GAPPY_ORDERS} WHERE o_orderstatus IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderstatus) FROM {GAPPY_ORDERS}"""),
    "fill_nulls_forward_backward": (
        lambda s, d: R.fill_nulls(R.fill_nulls(gappy_events(s, d).withColumn("other", F.col("value")), ["value"], "ffill", order_by=["event_id"]), ["other"], "bfill", order_by=["event_id"]),
        f"""SELECT * REPLACE (last_value(value IGNORE NULLS) OVER (ORDER BY event_id) AS value), first_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS other FROM {GAPPY}"""),
    "add_rows": (
        lambda s, d: R.add_rows(t(s, d, "nation"), [{"n_nationkey": 98, "n_name": "NEW"}, {"n_nationkey": 99, "n_regionkey": 1, "note": "added"}], "bottom", "place"),
        """SELECT n_nationkey, n_name, n_regionkey, 0::INTEGER AS place, NULL::VARCHAR AS note FROM nation
           UNION ALL SELECT 98, 'NEW', NULL, 1, NULL UNION ALL SELECT 99, NULL, 1, 1, 'added'"""),
    "sample_rows_facts": (
        lambda s, d: sample_facts(s, d),
        """SELECT least(2000, count(*))::BIGINT AS n, least(2000, count(*))::BIGINT AS n_distinct, 0::BIGINT AS outside, 0::BIGINT AS changed, least(1500, count(*))::BIGINT AS unseeded,
           CASE WHEN count(*) > 0 THEN 3000 ELSE 0 END::BIGINT AS replaced, 0::BIGINT AS replaced_outside, true AS fraction_near FROM orders"""),
    "sample_rows": (lambda s, d: R.sample_rows(t(s, d, "customer"), n=100, seed=7, key=["c_custkey"]), None),
    "sample_rows_fraction": (lambda s, d: R.sample_rows(t(s, d, "customer"), fraction=0.2, seed=7), None),
    "sample_rows_replace": (lambda s, d: R.sample_rows(t(s, d, "customer"), n=200, seed=7, replace=True, key=["c_custkey"]), None),
    "shuffle_rows": (lambda s, d: R.shuffle_rows(t(s, d, "customer"), seed=3, key=["c_custkey"]), "SELECT * FROM customer"),
    "row_number": (
        lambda s, d: R.row_number(t(s, d, "lineitem"), "row_num", 100, order_by=LINE_ORDER).select("l_orderkey", "l_linenumber", "l_extendedprice", "row_num"),
        f"SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (ORDER BY {LINE_BY}) + 99 AS row_num FROM lineitem"),
    "row_number_partitioned": (
        lambda s, d: R.row_number(gappy_orders(s, d), "n", 1, ["o_orderstatus"], order_by=["-o_totalprice", "o_orderkey"]),
        f"SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS n FROM {GAPPY_ORDERS}"),
    "explode_column": (
        lambda s, d: R.explode_column(t(s, d, "part").selectExpr("p_partkey", "replace(nullif(p_name, 'red widget'), ' ', ' ; ') AS p_name"), "p_name", ";"),
        """SELECT p_partkey, unnest(CASE WHEN p_name = 'red widget' THEN [NULL] ELSE string_split(p_name, ' ') END) AS p_name FROM part"""),
    "explode_arrays": (
        lambda s, d: R.explode(t(s, d, "embeddings"), ["embedding"]).selectExpr("vec_id", "CAST(embedding AS double) AS embedding", "label"),
        "SELECT vec_id, unnest(embedding)::DOUBLE AS embedding, label FROM embeddings"),
}
