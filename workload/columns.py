"""Column operators."""

from pyspark.sql import functions as F

from cleanloom.operators import columns as C

from .base import CUSTOMER_ORDERS, GAPPY, GAPPY_ORDERS, customer_orders, gappy_events, gappy_orders, t


def mixed_dates(s, d):
    """order dates written in four layouts"""
    return t(s, d, "orders").select("o_orderkey", F.expr("""CASE pmod(o_orderkey, 4) WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd')
        WHEN 1 THEN date_format(o_orderdate, 'MM/dd/yyyy') WHEN 2 THEN date_format(o_orderdate, 'MMM d, yyyy') ELSE 'n/a' END""").alias("day"))


def number_words(s, d):
    return t(s, d, "events").select("event_id", F.expr(
        "CASE WHEN event_type = 'error' THEN 'n/a' WHEN event_type = 'view' THEN concat(' ', CAST(event_id AS string), ' ') ELSE format_string('%.2f', value) END").alias("raw"))


NUMBER_WORDS = """(SELECT event_id, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'view' THEN event_id::DOUBLE ELSE round(value, 2) END AS x FROM events)"""

Q = {
    "select_columns": (lambda s, d: C.select_columns(t(s, d, "customer"), ["c_name", "c_custkey"]), "SELECT c_name, c_custkey FROM customer"),
    "select_columns_lenient": (lambda s, d: C.select_columns(t(s, d, "customer"), ["c_name", "nope", "c_acctbal"], False), "SELECT c_name, c_acctbal FROM customer"),
    "remove_columns": (lambda s, d: C.remove_columns(t(s, d, "customer"), ["c_acctbal", "nope"]), "SELECT * EXCLUDE (c_acctbal) FROM customer"),
    "rename_columns": (
        lambda s, d: C.rename_columns(t(s, d, "customer"), {"c_name": "name", "c_acctbal": "balance"}),
        "SELECT c_custkey, c_name AS name, c_nationkey, c_acctbal AS balance, c_mktsegment FROM customer"),
    "rename_column_lenient": (
        lambda s, d: C.rename_columns(t(s, d, "nation"), {"n_name": "name", "nope": "x"}, False), "SELECT n_nationkey, n_name AS name, n_regionkey FROM nation"),
    "reorder_columns": (lambda s, d: C.reorder_columns(t(s, d, "customer"), ["c_mktsegment"]), "SELECT c_mktsegment, c_custkey, c_name, c_nationkey, c_acctbal FROM customer"),
    "reorder_columns_strict": (lambda s, d: C.reorder_columns(t(s, d, "customer"), ["c_mktsegment", "c_custkey"], True), "SELECT c_mktsegment, c_custkey FROM customer"),
    "add_column": (lambda s, d: C.add_column(t(s, d, "nation"), "source", "erp", position="start"), "SELECT 'erp' AS source, * FROM nation"),
    "add_column_copy": (lambda s, d: C.add_column(t(s, d, "nation"), "key2", from_column="n_nationkey", position=1), "SELECT *, n_nationkey AS key2 FROM nation"),
    "add_expression": (
        lambda s, d: C.add_expression(t(s, d, "lineitem"), "l_extendedprice * (1 - l_discount)", "revenue").select("l_orderkey", "l_linenumber", "l_extendedprice", "revenue"),
        "SELECT l_orderkey, l_linenumber, l_extendedprice, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem"),
    "copy_column": (lambda s, d: C.copy_column(t(s, d, "part"), "p_name", "label"), "SELECT *, p_name AS label FROM part"),
    "split_column": (
        lambda s, d: C.split_column(t(s, d, "customer").select("c_custkey", "c_name"), "c_name", "#", ["kind", "number", "none"]),
        "SELECT c_custkey, split_part(c_name, '#', 1) AS kind, split_part(c_name, '#', 2) AS number, NULL::VARCHAR AS none FROM customer"),
    "split_column_numbered": (
        lambda s, d: C.split_column(t(s, d, "part").select("p_partkey", "p_name"), "p_name", " ", keep_original=True),
        "SELECT p_partkey, p_name, string_split(p_name, ' ')[1] AS p_name_1, string_split(p_name, ' ')[2] AS p_name_2 FROM part"),
    "split_column_array": (
        lambda s, d: C.split_column(t(s, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "-", expand=False).selectExpr(
            "o_orderkey", "size(o_orderpriority) AS n", "o_orderpriority[0] AS head"),
        "SELECT o_orderkey, len(string_split(o_orderpriority, '-'))::INTEGER AS n, string_split(o_orderpriority, '-')[1] AS head FROM orders"),
    "split_column_max": (
        lambda s, d: C.split_column(t(s, d, "pages").select("page_id", "url"), "url", "/", ["scheme", "rest"], max_splits=1),
        "SELECT page_id, split_part(url, '/', 1) AS scheme, substr(url, instr(url, '/') + 1) AS rest FROM pages"),
    "merge_columns": (
        lambda s, d: C.merge_columns(gappy_orders(s, d).select("o_orderkey", "o_orderstatus", "o_orderpriority"), ["o_orderstatus", "o_orderpriority"], "tag", "|"),
        f"SELECT o_orderkey, coalesce(o_orderstatus, 'nan') || '|' || o_orderpriority AS tag FROM {GAPPY_ORDERS}"),
    "merge_columns_keep": (
        lambda s, d: C.merge_columns(t(s, d, "nation"), ["n_name", "n_regionkey"], "merged", " ", True), "SELECT *, n_name || ' ' || n_regionkey AS merged FROM nation"),
    "concat_columns": (
        lambda s, d: C.concat_columns(customer_orders(s, d).select("c_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority"), ["o_orderstatus", "o_orderpriority"], "tag", "/"),
        f"SELECT c_custkey, o_orderkey, o_orderstatus, o_orderpriority, o_orderstatus || '/' || o_orderpriority AS tag FROM {CUSTOMER_ORDERS}"),
    "concat_columns_null_text": (
        lambda s, d: C.concat_columns(gappy_orders(s, d).select("o_orderkey", "o_orderstatus", "o_custkey"), ["o_orderstatus", "o_custkey"], "tag", "-", False),
        f"SELECT o_orderkey, o_orderstatus, o_custkey, coalesce(o_orderstatus, 'nan') || '-' || o_custkey AS tag FROM {GAPPY_ORDERS}"),
    "change_type_float": (
        lambda s, d: C.change_column_type(number_words(s, d), "raw", "float"), f"SELECT event_id, x AS raw FROM {NUMBER_WORDS}"),
    "change_type_integer": (
        lambda s, d: C.change_column_type(number_words(s, d), "raw", "integer"), f"SELECT event_id, CASE WHEN x = floor(x) THEN x::BIGINT END AS raw FROM {NUMBER_WORDS}"),
    "change_type_datetime": (
        lambda s, d: C.change_column_type(mixed_dates(s, d), "day", "datetime"),
        "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN o_orderdate END AS day FROM orders"),
    "change_type_boolean": (
        lambda s, d: C.change_column_type(t(s, d, "labels").selectExpr("doc_id", "CASE WHEN quality = 1 THEN 'Yes' WHEN toxic = 1 THEN 'maybe' ELSE 'F' END AS flag"), "flag", "boolean"),
        "SELECT doc_id, CASE WHEN quality = 1 THEN true WHEN toxic = 1 THEN NULL ELSE false END AS flag FROM labels"),
    "change_type_string": (
        lambda s, d: C.change_column_type(t(s, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "string"), "SELECT o_orderkey, o_custkey::VARCHAR AS o_custkey FROM orders"),
    "change_type_ignore": (
        lambda s, d: C.change_column_type(t(s, d, "customer").select("c_custkey", "c_name"), "c_name", "float", errors="ignore"), "SELECT c_custkey, c_name FROM customer"),
    "convert_type_boolean": (
        lambda s, d: C.convert_type(t(s, d, "events").selectExpr("event_id", "CASE event_type WHEN 'click' THEN 'no' WHEN 'view' THEN '' ELSE event_type END AS flag"), ["flag"], "bool"),
        "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN false ELSE true END AS flag FROM events"),
    "coalesce": (
        lambda s, d: C.coalesce(customer_orders(s, d).select("c_custkey", "o_orderkey", "o_orderstatus", "c_mktsegment"), ["o_orderstatus", "c_mktsegment"], "tag"),
        f"SELECT c_custkey, o_orderkey, o_orderstatus, c_mktsegment, coalesce(o_orderstatus, c_mktsegment) AS tag FROM {CUSTOMER_ORDERS}"),
    "coalesce_default": (
        lambda s, d: C.coalesce(gappy_events(s, d).select("event_id", "value"), ["value"], "v", 0.0), f"SELECT event_id, value, coalesce(value, 0.0::DOUBLE) AS v FROM {GAPPY}"),
    "replace_null": (
        lambda s, d: C.replace_null(customer_orders(s, d).select("c_custkey", "o_orderkey", "o_totalprice", "o_orderstatus"), 0),
        f"SELECT c_custkey, coalesce(o_orderkey, 0) AS o_orderkey, coalesce(o_totalprice, 0) AS o_totalprice, o_orderstatus FROM {CUSTOMER_ORDERS}"),
    "replace_null_columns": (
        lambda s, d: C.replace_null(customer_orders(s, d).select("c_custkey", "o_orderkey", "o_orderstatus"), "none", ["o_orderstatus"]),
        f"SELECT c_custkey, o_orderkey, coalesce(o_orderstatus, 'none') AS o_orderstatus FROM {CUSTOMER_ORDERS}"),
    "generate_uuid_facts": (
        lambda s, d: C.generate_uuid(t(s, d, "customer"), "uuid").agg(
            F.count(F.lit(1)).alias("n"), F.count_distinct("uuid").alias("n_distinct"), F.count_if(~F.col("uuid").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")).alias("malformed")),
        "SELECT count(*) AS n, count(*) AS n_distinct, 0::BIGINT AS malformed FROM customer"),
    "generate_uuid": (lambda s, d: C.generate_uuid(t(s, d, "customer"), "uuid", "short", "c-"), None),
    "fill_forward": (
        lambda s, d: C.fill_forward(gappy_events(s, d), ["value"], order_by=["event_id"]),
        f"SELECT * REPLACE (last_value(value IGNORE NULLS) OVER (ORDER BY event_id) AS value) FROM {GAPPY}"),
    "fill_forward_grouped": (
        lambda s, d: C.fill_forward(gappy_events(s, d), ["value"], group_by="user_id", order_by=["event_id"]),
        f"SELECT * REPLACE (last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS value) FROM {GAPPY}"),
    "fill_forward_limit": (
        lambda s, d: C.fill_forward(gappy_events(s, d), ["value"], limit=1, order_by=["event_id"]),
        f"SELECT * REPLACE (last_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS value) FROM {GAPPY}"),
    "fill_backward": (
        lambda s, d: C.fill_backward(gappy_events(s, d), ["value"], order_by=["event_id"]),
        f"SELECT * REPLACE (first_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value) FROM {GAPPY}"),
    "fill_backward_limit_grouped": (
        lambda s, d: C.fill_backward(gappy_events(s, d), ["value"], limit=2, group_by="event_type", order_by=["ts", "event_id"]),
        f"SELECT * REPLACE (first_value(value IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS value) FROM {GAPPY}"),
    "sanitize_headers": (
        lambda s, d: C.sanitize_headers(t(s, d, "nation").toDF("Nation Key", "nationName!", "  Region-Key")),
        "SELECT n_nationkey AS nation_key, n_name AS nation_name, n_regionkey AS region_key FROM nation"),
    "sanitize_headers_camel": (
        lambda s, d: C.sanitize_headers(t(s, d, "nation").toDF("Nation Key", "nation_name", "REGION key"), "camelCase"),
        'SELECT n_nationkey AS "nationKey", n_name AS "nationName", n_regionkey AS "regionKey" FROM nation'),
}
