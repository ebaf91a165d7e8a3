"""Quality, drift and check operators."""

from pyspark.sql import functions as F

from cleanloom.operators import calculate as K, columns as C, format as M, groups as G, quality as V, rows as R, tables as J, text as X
from cleanloom.plans import checks as H, schemas as Z

from .base import CUSTOMER_ORDERS, GAPPY, GAPPY_ORDERS, customer_orders, gappy_events, gappy_orders, shared_folder, t
from .texts import phones

EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"


def drifted_orders(s, d):
    """orders with a renamed, a retyped, a nulled and a missing column, and a new status"""
    return t(s, d, "orders").selectExpr("o_orderkey", "o_custkey AS o_cust_key", "CASE WHEN o_orderstatus = 'P' THEN 'Pending' ELSE nullif(o_orderstatus, 'F') END AS o_orderstatus",
                                        "CAST(o_totalprice AS string) AS o_totalprice", "o_orderpriority", "o_orderdate")


EXPECTED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_clerk"]
TYPES = {"o_orderkey": "integer", "o_orderstatus": "string", "o_totalprice": "float", "o_orderpriority": "string"}

BASE_LINE = {"mean": 25.0, "std": 10.0, "min": 1.0, "max": 50.0, "p25": 13.0, "p50": 20.0, "p75": 38.0}


def null_rows(cols, source):
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS null_count, round_even(count(*) FILTER ({c} IS NULL) / count(*)::DOUBLE, 4) AS null_rate, "
                              f"count(*) FILTER ({c} IS NULL) / count(*)::DOUBLE > 0.5 AS over_threshold FROM {source}" for c in cols)


def issue(check, severity, column, message, before, after, source="", where="true"):
    """SQL of one issue row"""
    q = lambda v: "NULL::VARCHAR" if v is None else f"'{v}'"
    return (f"SELECT '{check}' AS check_name, {severity if severity.startswith('CASE') else q(severity)} AS severity, {q(column)} AS \"column\", {q(message)} AS message, "
            f"({before})::DOUBLE AS before, ({after})::DOUBLE AS after {source} WHERE {where}")


def run(before, after, plan, checks=None):
    return lambda s, d: H.validate(before(s, d), after(s, d), plan, checks)


orders = lambda s, d: t(s, d, "orders")
events = lambda s, d: t(s, d, "events")
N = "(SELECT count(*) FROM orders)"

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table_schemas(s, d):
    """the schemas of all fourteen tables, from the footers of their files"""
    return Z.parquet_schemas(s, [f"{d}/{n}.parquet" for n in TABLES])


def expectations(s, d):
    """what is expected of the tables: some columns by another name, some of another type, some new ones"""
    have, p = table_schemas(s, d), F.col("position")
    name = F.when(p % 4 == 1, F.concat("column", F.lit("_new"))).when(p % 4 == 2, F.concat(F.substring("column", 1, 3), F.lit("x"), F.substring("column", 4, 99))).otherwise(F.col("column"))
    kind = F.when(p % 5 == 3, "string").otherwise(F.col("type_class"))
    return have.select("table", "position", name.alias("column"), kind.alias("type_class"), F.lit(False).alias("nullable"), F.lit(False).alias("extra_ok"))


SCHEMAS_SQL = """WITH h AS (SELECT table_name AS "table", ordinal_position - 1 AS pos, column_name AS col, CASE WHEN data_type IN ('BIGINT', 'INTEGER') THEN 'integer' WHEN data_type IN ('DOUBLE', 'FLOAT') THEN 'float'
             WHEN data_type LIKE 'TIMESTAMP%' THEN 'datetime' WHEN data_type = 'BOOLEAN' THEN 'boolean' ELSE 'string' END AS class FROM information_schema.columns WHERE table_name IN (""" + ", ".join(f"'{n}'" for n in TABLES) + """)),
           w AS (SELECT "table", pos, CASE pos % 4 WHEN 1 THEN col || '_new' WHEN 2 THEN left(col, 3) || 'x' || col[4:] ELSE col END AS col, CASE WHEN pos % 5 = 3 THEN 'string' ELSE class END AS class FROM h)"""


def copies(s, d):
    """orders and events written with drift: nulls, a renamed column, a number as text"""
    folder = shared_folder(s)
    gappy_orders(s, d).withColumnRenamed("o_custkey", "o_cust_key").write.parquet(f"{folder}/orders.parquet")
    gappy_events(s, d).withColumn("user_id", F.col("user_id").cast("string")).write.parquet(f"{folder}/events.parquet")
    return Z.parquet_schemas(s, [f"{folder}/orders.parquet", f"{folder}/events.parquet"])


def drifted_copies(s, d):
    wanted = table_schemas(s, d).where("`table` IN ('orders', 'events')").select("table", "position", "column", "type_class", F.lit(False).alias("nullable"), F.lit(False).alias("extra_ok"))
    return Z.drift(copies(s, d), wanted)


def copies_changed(s, d):
    return Z.changes(table_schemas(s, d).where("`table` IN ('orders', 'events')"), copies(s, d))


Q = {
    "detect_nulls_flags": (
        lambda s, d: V.detect_nulls(customer_orders(s, d).select("c_custkey", "o_orderkey", "o_orderstatus"), add_null_flag=True, add_null_count=True),
        f"SELECT c_custkey, o_orderkey, o_orderstatus, o_orderkey IS NULL AS _has_null, CASE WHEN o_orderkey IS NULL THEN 2 ELSE 0 END AS _null_count FROM {CUSTOMER_ORDERS}"),
    "null_metrics": (
        lambda s, d: V.null_metrics(gappy_orders(s, d), threshold=0.5), null_rows(["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], GAPPY_ORDERS)),
    "null_summary": (
        lambda s, d: V.null_summary(customer_orders(s, d).select("c_custkey", "o_orderkey", "o_orderstatus")),
        f"""SELECT count(*) AS rows, count(*) FILTER (o_orderkey IS NULL) AS rows_with_null, 2 * count(*) FILTER (o_orderkey IS NULL) AS null_cells,
            round_even(2 * count(*) FILTER (o_orderkey IS NULL) / (3.0::DOUBLE * count(*)), 4) AS overall_null_rate FROM {CUSTOMER_ORDERS}"""),
    "profile_column_number": (
        lambda s, d: V.profile_column(gappy_events(s, d), "value").selectExpr(
            "`column`", "dtype", "row_count", "null_count", "unique_count", "min", "max", "bround(mean, 4) AS mean", "bround(std, 4) AS std", "bround(sum, 2) AS sum",
            "bround(p25, 4) AS p25", "bround(p50, 4) AS p50", "bround(p75, 4) AS p75", "high_null", "all_unique", "constant"),
        f"""SELECT 'value' AS "column", 'float' AS dtype, count(*) AS row_count, count(*) - count(value) AS null_count, count(DISTINCT value) AS unique_count, min(value) AS min, max(value) AS max,
            round_even(avg(value), 4) AS mean, round_even(stddev_samp(value), 4) AS std, round_even(sum(value), 2) AS sum, round_even(quantile_cont(value, 0.25), 4) AS p25,
            round_even(quantile_cont(value, 0.5), 4) AS p50, round_even(quantile_cont(value, 0.75), 4) AS p75, (count(*) - count(value)) / count(*) > 0.5 AS high_null,
            count(DISTINCT value) = count(*) AS all_unique, count(DISTINCT value) = 1 AS constant FROM {GAPPY}"""),
    "profile_column_text": (
        lambda s, d: V.profile_column(t(s, d, "documents"), "text").selectExpr("`column`", "dtype", "row_count", "null_count", "unique_count", "min_length", "max_length",
                                                                              "bround(avg_length, 4) AS avg_length", "high_null", "all_unique", "constant"),
        """SELECT 'text' AS "column", 'string' AS dtype, count(*) AS row_count, 0::BIGINT AS null_count, count(DISTINCT text) AS unique_count, min(length(text))::INTEGER AS min_length,
           max(length(text))::INTEGER AS max_length, round_even(avg(length(text)), 4) AS avg_length, false AS high_null, count(DISTINCT text) = count(*) AS all_unique, false AS constant FROM documents"""),
    "top_values": (
        lambda s, d: V.top_values(t(s, d, "documents"), "source", 5), "SELECT source AS value, count(*) AS count FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"),
    "validate_pattern": (
        lambda s, d: V.validate_pattern(t(s, d, "pages").select("page_id", "url"), "url", r"https://[a-z.]+/en"), "SELECT page_id, url, regexp_matches(url, '^(?:https://[a-z.]+/en)') AS url_valid FROM pages"),
    "validate_pattern_type_nulls": (
        lambda s, d: V.validate_pattern(phones(s, d), "phone", pattern_type="phone"),
        r"""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN '(555) 010-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') WHEN 1 THEN '+1 555.020.' || lpad((c_custkey % 10000)::VARCHAR, 4, '0')
            WHEN 2 THEN '555030' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') WHEN 3 THEN '0044 555 040 ' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') WHEN 4 THEN 'ext. 12' END AS phone,
            c_custkey % 6 < 4 AS phone_valid FROM customer"""),
    "pattern_metrics": (
        lambda s, d: V.pattern_metrics(t(s, d, "pages"), "url", pattern_type="url"),
        r"""SELECT count(*) FILTER (ok) AS valid_count, count(*) FILTER (NOT ok) AS invalid_count, round_even(count(*) FILTER (ok) / count(*)::DOUBLE, 4) AS valid_rate
            FROM (SELECT regexp_matches(url, '^https?://[^\s/$.?#].[^\s]*$') AS ok FROM pages)"""),
    "invalid_samples": (
        lambda s, d: V.invalid_samples(t(s, d, "pages").select("page_id", "url"), "url", r"https://", order_by=["page_id"]),
        "SELECT url FROM pages WHERE NOT starts_with(url, 'https://') ORDER BY page_id LIMIT 5"),
    "validate_format_flag": (
        lambda s, d: V.validate_format(t(s, d, "customer").selectExpr("c_custkey", "CASE WHEN c_custkey % 5 = 0 THEN c_name ELSE concat('c', c_custkey, '@mail.example') END AS mail"), ["mail"]),
        f"SELECT *, regexp_matches(mail, '{EMAIL}') AS mail_valid FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_name ELSE 'c' || c_custkey || '@mail.example' END AS mail FROM customer)"),
    "validate_format_null": (
        lambda s, d: V.validate_format(t(s, d, "orders").selectExpr("o_orderkey", "split(o_orderpriority, '-')[1] AS word"), ["word"], "alphanumeric", invalid_action="null"),
        "SELECT o_orderkey, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN split_part(o_orderpriority, '-', 2) END AS word FROM orders"),
    "validate_format_remove": (
        lambda s, d: V.validate_format(t(s, d, "events").selectExpr("event_id", "CASE WHEN event_type = 'view' THEN props ELSE CAST(value AS string) END AS x"), ["x"], "numeric", invalid_action="remove")
        .select("event_id"),
        "SELECT event_id FROM events WHERE event_type <> 'view'"),
    "is_duplicate_first": (
        lambda s, d: V.is_duplicate(t(s, d, "documents").select("doc_id", "text"), ["text"], order_by=["doc_id"]).drop("text"),
        "SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS _is_duplicate FROM documents"),
    "is_duplicate_last": (
        lambda s, d: V.is_duplicate(gappy_orders(s, d), ["o_custkey", "o_orderstatus"], "last", "dup", order_by=["o_orderkey"]),
        f"SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey DESC) > 1 AS dup FROM {GAPPY_ORDERS}"),
    "is_duplicate_none": (
        lambda s, d: V.is_duplicate(t(s, d, "events"), ["user_id", "event_type"], "none", "is_duplicate"), "SELECT *, count(*) OVER (PARTITION BY user_id, event_type) > 1 AS is_duplicate FROM events"),
    "validate_schema": (
        lambda s, d: V.validate_schema(drifted_orders(s, d), EXPECTED, TYPES, False).join(
            V.null_metrics(drifted_orders(s, d)).select("column", "null_count"), "column", "left"),
        """SELECT * FROM (VALUES ('missing', 'o_custkey', 'o_custkey', NULL), ('missing', 'o_clerk', 'o_clerk', NULL), ('extra', 'o_cust_key', NULL, 'o_cust_key'),
           ('extra', 'o_orderdate', NULL, 'o_orderdate'), ('type', 'o_totalprice', 'number', 'string')) v(kind, "column", expected, observed)
           LEFT JOIN (SELECT unnest(['o_cust_key', 'o_orderdate', 'o_totalprice']) AS "column", count(*) FILTER (o_totalprice IS NULL) AS null_count FROM orders) USING ("column")"""),
    "compare_schemas": (
        lambda s, d: V.compare_schemas(drifted_orders(s, d), EXPECTED, TYPES, {"o_orderstatus": False, "o_orderpriority": False}),
        """SELECT * FROM (VALUES ('missing', 'o_custkey', 'o_custkey', NULL), ('missing', 'o_clerk', 'o_clerk', NULL), ('extra', 'o_cust_key', NULL, 'o_cust_key'),
           ('extra', 'o_orderdate', NULL, 'o_orderdate'), ('type', 'o_totalprice', 'float', 'string')) v(kind, "column", expected, observed)
           UNION ALL SELECT 'nullable', 'o_orderstatus', 'no nulls', count(*) || ' nulls' FROM orders WHERE o_orderstatus = 'F'"""),
    "detect_renamed_columns": (
        lambda s, d: V.detect_renamed_columns(drifted_orders(s, d), EXPECTED).join(V.null_metrics(drifted_orders(s, d)).selectExpr("`column` AS observed", "null_count"), "observed"),
        "SELECT 'o_custkey' AS expected, 'o_cust_key' AS observed, 0.88::DOUBLE AS name_similarity, 'high' AS confidence, 'integer' AS observed_type, count(*) FILTER (o_custkey IS NULL) AS null_count FROM orders"),
    "schema_drift_tables": (
        lambda s, d: Z.drift(table_schemas(s, d), expectations(s, d)),
        SCHEMAS_SQL + """ SELECT w."table", 'missing' AS kind, w.col AS "column", w.col AS expected, NULL AS observed FROM w LEFT JOIN h ON h."table" = w."table" AND h.col = w.col WHERE h.col IS NULL
           UNION ALL SELECT h."table", 'extra', h.col, NULL, h.col FROM h LEFT JOIN w ON h."table" = w."table" AND h.col = w.col WHERE w.col IS NULL
           UNION ALL SELECT h."table", 'type', h.col, w.class, h.class FROM h JOIN w ON h."table" = w."table" AND h.col = w.col WHERE h.class <> w.class"""),
    "schema_renames_tables": (
        lambda s, d: Z.renames(table_schemas(s, d), expectations(s, d)),
        SCHEMAS_SQL + """, g AS (SELECT w."table", w.col AS a, h.col AS b, h.pos, h.class FROM w JOIN h USING ("table") WHERE NOT EXISTS (SELECT 1 FROM h q WHERE q."table" = w."table" AND q.col = w.col)
             AND NOT EXISTS (SELECT 1 FROM w q WHERE q."table" = h."table" AND q.col = h.col)),
           e AS (SELECT *, greatest(length(a), length(b))::DOUBLE AS most, least(length(a), length(b))::DOUBLE AS least_, list_transform(range(1, least(length(a), length(b)) + 1), lambda i: (a[i] = b[i])::INT) AS same,
             list_distinct(string_split_regex(a, '[_\\s]')) AS x, list_distinct(string_split_regex(b, '[_\\s]')) AS y FROM g),
           f AS (SELECT *, CASE WHEN contains(a, b) OR contains(b, a) THEN least_ / most + 0.2 ELSE least(1.0, list_sum(same) / most + coalesce(nullif(list_position(same, 0), 0) - 1, least_) / most * 0.3
             + len(list_intersect(x, y)) / greatest(len(x), len(y))::DOUBLE * 0.3) END AS score FROM e)
           SELECT "table", a AS expected, b AS observed, round_even(score, 3) AS name_similarity, CASE WHEN score > 0.8 THEN 'high' WHEN score > 0.6 THEN 'medium' ELSE 'low' END AS confidence, class AS observed_type
           FROM f WHERE score >= 0.6 QUALIFY row_number() OVER (PARTITION BY "table", a ORDER BY score DESC, pos) = 1"""),
    "schema_nulls_of_drifted_copies": (
        drifted_copies,
        f"""SELECT 'events' AS "table", 'nullable' AS kind, 'value' AS "column", 'no nulls' AS expected, count(*) || ' nulls' AS observed FROM {GAPPY} WHERE value IS NULL
           UNION ALL SELECT 'orders', 'nullable', 'o_orderstatus', 'no nulls', count(*) || ' nulls' FROM {GAPPY_ORDERS} WHERE o_orderstatus IS NULL
           UNION ALL SELECT 'orders', 'missing', 'o_custkey', 'o_custkey', NULL FROM orders HAVING count(*) > 0
           UNION ALL SELECT 'orders', 'extra', 'o_cust_key', NULL, 'o_cust_key' FROM orders HAVING count(*) > 0
           UNION ALL SELECT 'events', 'type', 'user_id', 'integer', 'string' FROM events HAVING count(*) > 0"""),
    "schema_changes_tables": (
        copies_changed,
        f"""SELECT 'orders' AS "table", 'missing' AS kind, 'o_custkey' AS "column", 'o_custkey' AS expected, NULL AS observed FROM orders HAVING count(*) > 0
           UNION ALL SELECT 'orders', 'extra', 'o_cust_key', NULL, 'o_cust_key' FROM orders HAVING count(*) > 0
           UNION ALL SELECT 'events', 'type', 'user_id', 'integer', 'string' FROM events HAVING count(*) > 0"""),
    "infer_types": (
        lambda s, d: V.infer_types(t(s, d, "orders").selectExpr(
            "CAST(o_orderkey AS string) AS key", "CAST(o_totalprice AS string) AS price", "date_format(o_orderdate, 'M/d/yyyy') AS day", "o_orderstatus AS status",
            "CASE o_orderstatus WHEN 'O' THEN 'yes' WHEN 'F' THEN 'N' END AS open", "CAST(NULL AS string) AS empty", "o_custkey", "o_totalprice", "o_orderdate")),
        """SELECT col AS "column", cur AS current_type, inf AS inferred_type, conf::DOUBLE AS confidence FROM (VALUES ('key', 'string', 'integer', 0.9), ('price', 'string', 'float', 0.9),
           ('day', 'string', 'datetime', 1.0), ('status', 'string', 'string', 0.8), ('open', 'string', 'boolean', 0.95), ('empty', 'string', 'unknown', 0.0), ('o_custkey', 'integer', 'integer', 1.0),
           ('o_totalprice', 'float', 'float', 1.0), ('o_orderdate', 'datetime', 'datetime', 1.0)) v(col, cur, inf, conf) WHERE (SELECT count(*) FROM orders) > 0"""),
    "convert_inferred": (
        lambda s, d: V.convert_inferred(t(s, d, "orders").selectExpr("CAST(o_orderkey AS string) AS key", "date_format(o_orderdate, 'yyyy/M/d') AS day",
                                                                    "CASE o_orderstatus WHEN 'O' THEN 'yes' WHEN 'F' THEN 'N' END AS open")),
        "SELECT o_orderkey AS key, o_orderdate AS day, o_orderstatus = 'O' AS open FROM orders"),
    "detect_enum_drift": (
        lambda s, d: V.detect_enum_drift(gappy_orders(s, d), "o_orderstatus", ["o", "x"]), f"SELECT *, NOT coalesce(lower(o_orderstatus) IN ('o', 'x'), false) AS o_orderstatus_enum_drift FROM {GAPPY_ORDERS}"),
    "enum_metrics": (
        lambda s, d: V.enum_metrics(t(s, d, "orders"), "o_orderstatus", ["o", "X", "f"]),
        "SELECT o_orderstatus AS value, 'new' AS kind, count(*) AS count FROM orders WHERE o_orderstatus = 'P' GROUP BY 1 UNION ALL SELECT 'x', 'missing', 0"),
    "format_metrics": (
        lambda s, d: V.format_metrics(t(s, d, "orders").selectExpr("CASE o_orderstatus WHEN 'O' THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 'F' THEN date_format(o_orderdate, 'M/d/yyyy') "
                                                                   "ELSE date_format(o_orderdate, 'dd.MM.yyyy') END AS day"), "day", format_type="date_iso"),
        """SELECT f AS format, n AS match_count, round_even(n / (SELECT count(*) FROM orders)::DOUBLE, 4) AS match_rate FROM (
           SELECT CASE o_orderstatus WHEN 'O' THEN 'expected' WHEN 'F' THEN 'date_us' ELSE 'date_eu' END AS f, count(*) AS n FROM orders GROUP BY 1)"""),
    "distribution_drift_numeric": (
        lambda s, d: V.distribution_drift(t(s, d, "lineitem"), "l_quantity", BASE_LINE),
        """WITH o AS (UNPIVOT (SELECT avg(l_quantity) AS mean, stddev_samp(l_quantity) AS std, min(l_quantity) AS min, max(l_quantity) AS max, quantile_cont(l_quantity, 0.25) AS p25,
             quantile_cont(l_quantity, 0.5) AS p50, quantile_cont(l_quantity, 0.75) AS p75 FROM lineitem) ON mean, std, min, max, p25, p50, p75 INTO NAME metric VALUE v),
           b AS (SELECT * FROM (VALUES ('mean', 25.0), ('std', 10.0), ('min', 1.0), ('max', 50.0), ('p25', 13.0), ('p50', 20.0), ('p75', 38.0)) x(metric, b))
           SELECT metric, b::DOUBLE AS baseline, round_even(v, 4) AS observed, round_even(abs(v - b::DOUBLE) / b::DOUBLE, 4) AS difference, abs(v - b::DOUBLE) / b::DOUBLE > 0.1 AS drifted FROM o JOIN b USING (metric)"""),
    "distribution_drift_categories": (
        lambda s, d: V.distribution_drift(t(s, d, "events"), "event_type", None, {"click": 0.4, "view": 0.25, "refund": 0.05}, 0.15),
        """WITH o AS (SELECT event_type AS metric, round_even(count(*) / (SELECT count(*) FROM events)::DOUBLE, 4) AS share FROM events GROUP BY 1),
           b AS (SELECT * FROM (VALUES ('click', 0.4), ('view', 0.25), ('refund', 0.05)) x(metric, base))
           SELECT metric, coalesce(base, 0)::DOUBLE AS baseline, coalesce(share, 0) AS observed, round_even(abs(coalesce(share, 0) - coalesce(base, 0)::DOUBLE), 4) AS difference,
           round_even(abs(coalesce(share, 0) - coalesce(base, 0)::DOUBLE), 4) > 0.15 AS drifted FROM o FULL JOIN b USING (metric)"""),
    "drift_score": (
        lambda s, d: V.drift_score(V.distribution_drift(t(s, d, "lineitem"), "l_quantity", {"mean": 25.0, "max": 100.0})),
        """SELECT round_even((round_even(abs(avg(l_quantity) - 25) / 25, 4) + round_even(abs(max(l_quantity) - 100) / 100, 4)) / 2, 4) AS drift_score,
           (CASE WHEN abs(avg(l_quantity) - 25) / 25 > 0.1 THEN 1 ELSE 0 END + CASE WHEN abs(max(l_quantity) - 100) / 100 > 0.1 THEN 1 ELSE 0 END)::BIGINT AS drifted_metrics, true AS has_drift FROM lineitem"""),
    "normalize_boolean": (
        lambda s, d: V.normalize_boolean(t(s, d, "events").selectExpr("event_id", "CASE event_type WHEN 'view' THEN ' YES ' WHEN 'click' THEN 'off' WHEN 'error' THEN 'perhaps' WHEN 'signup' THEN '' END AS flag"),
                                         "flag", null_handling="true"),
        "SELECT event_id, CASE event_type WHEN 'view' THEN true WHEN 'click' THEN false WHEN 'error' THEN NULL WHEN 'signup' THEN false ELSE true END AS flag FROM events"),
    "normalize_boolean_integer": (
        lambda s, d: V.normalize_boolean(t(s, d, "labels"), "quality", output_format="integer"), "SELECT doc_id, quality, toxic FROM labels"),
    "boolean_metrics": (
        lambda s, d: V.boolean_metrics(gappy_orders(s, d), "o_orderstatus", ["o"], ["x"]),
        f"""SELECT count(*) FILTER (o_orderstatus = 'O') AS true_count, 0::BIGINT AS false_count, count(*) FILTER (o_orderstatus IS NULL) AS null_count,
            count(*) FILTER (o_orderstatus = 'F') AS unknown_count FROM {GAPPY_ORDERS}"""),
    "normalize_enum_values": (
        lambda s, d: V.normalize_enum_values(t(s, d, "orders"), "o_orderpriority", {"1-URGENT": "now", "2-high": "now", "3-MEDIUM": "soon"}, unmapped_handling="null"),
        "SELECT * REPLACE (CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'now' WHEN o_orderpriority = '3-MEDIUM' THEN 'soon' END AS o_orderpriority) FROM orders"),
    "drift_report": (
        lambda s, d: V.generate_drift_report(drifted_orders(s, d).withColumn("price", F.col("o_totalprice").cast("double")), EXPECTED, TYPES, {"o_orderstatus": ["O", "F"]},
                                             {"price": {"mean": 100.0, "std": 5.0}}).drop("recommendation"),
        """SELECT * FROM (VALUES ('missing', 'o_custkey', 'o_custkey', NULL, true), ('missing', 'o_clerk', 'o_clerk', NULL, true), ('extra', 'o_cust_key', NULL, 'o_cust_key', false),
           ('extra', 'o_orderdate', NULL, 'o_orderdate', false), ('extra', 'price', NULL, 'price', false), ('type', 'o_totalprice', 'float', 'string', true),
           ('renamed', 'o_custkey', 'o_custkey', 'o_cust_key', false)) v("check", "column", expected, observed, counts)
           UNION ALL SELECT DISTINCT 'enum', 'o_orderstatus', NULL, 'pending', true FROM orders WHERE o_orderstatus = 'P'
           UNION ALL SELECT 'enum', 'o_orderstatus', 'f', NULL, true
           UNION ALL SELECT 'distribution', 'price', 'baseline', concat_ws(',', CASE WHEN abs(avg(o_totalprice) - 100) / 100 > 0.1 THEN 'mean' END,
             CASE WHEN abs(stddev_samp(o_totalprice) - 5) / 5 > 0.1 THEN 'std' END), true FROM orders"""),
    "drift_report_summary": (
        lambda s, d: V.report_summary(V.generate_drift_report(t(s, d, "orders"), None, {"o_orderkey": "integer"}, {"o_orderstatus": ["O", "F"], "o_orderpriority": ["1-URGENT"]},
                                                              {"o_totalprice": {"mean": 1.0}})),
        "SELECT 3::BIGINT AS total_drifts, 'low' AS severity FROM orders HAVING count(DISTINCT o_orderstatus) > 2 AND count(DISTINCT o_orderpriority) > 1"),

    # checks ----------------------------------------------------------------
    "check_schema_valid": (
        run(orders, lambda s, d: t(s, d, "orders").where("o_totalprice < 0"), {"type": "filter_rows"}, ["schema_valid"]),
        issue("schema_valid", "warning", None, "all rows were removed", N, "0")),
    "check_target_columns_exist": (
        run(orders, lambda s, d: t(s, d, "orders").drop("o_custkey"), {"type": "sort_rows", "target_columns": ["o_custkey"]}, ["schema_valid", "target_columns_exist"]),
        issue("target_columns_exist", "error", "o_custkey", "target column is missing", "NULL", "NULL")),
    "check_column_types": (
        run(orders, lambda s, d: t(s, d, "orders").withColumn("o_custkey", F.col("o_custkey").cast("string")).withColumn("o_orderkey", F.col("o_orderkey").cast("double")),
            {"type": "filter_rows"}, ["column_types_preserved"]),
        issue("column_types_preserved", "info", "o_custkey", "type changed from integer to string", "NULL", "NULL")),
    "check_row_count_change": (
        run(orders, lambda s, d: t(s, d, "orders").where("o_orderstatus = 'F'"), {"type": "filter_rows"}, ["row_count_change", "filter_actually_filtered"]),
        issue("row_count_change", "warning", None, "large data reduction", N, "(SELECT count(*) FROM orders WHERE o_orderstatus = 'F')")),
    "check_filter_kept_all": (
        run(orders, lambda s, d: t(s, d, "orders").where("o_totalprice > 0"), {"type": "filter_rows"}), issue("filter_actually_filtered", "warning", None, "filter kept all rows", N, N)),
    "check_row_count_unchanged": (
        run(orders, lambda s, d: t(s, d, "orders").where("o_orderstatus <> 'F'"), {"type": "sort_rows"}, ["row_count_unchanged"]),
        issue("row_count_unchanged", "warning", None, "unexpected row change", N, "(SELECT count(*) FROM orders WHERE o_orderstatus <> 'F')")),
    "check_aggregation_row_count": (
        run(orders, lambda s, d: G.group_by(t(s, d, "orders"), ["o_orderkey"], {"o_totalprice": "sum"}), {"type": "group_by", "parameters": {"aggregations": {"o_totalprice": "sum"}}}),
        issue("aggregation_row_count", "info", None, "as many groups as rows", N, N)),
    "check_slice_bounds": (
        run(orders, lambda s, d: R.head_rows(t(s, d, "orders"), 7, order_by=["o_orderkey"]), {"type": "slice_rows", "parameters": {"n": 10}}, ["slice_bounds"]),
        issue("slice_bounds", "warning", None, "wrong number of rows", "10", "7")),
    "check_fill_nulls": (
        run(gappy_events, lambda s, d: C.fill_forward(gappy_events(s, d), ["value"], 1, order_by=["event_id"]), {"type": "fill_nulls", "target_columns": ["value"]}, ["fill_nulls_success"]),
        issue("fill_nulls_success", "info", "value", "some nulls remain", f"(SELECT count(*) FROM {GAPPY} WHERE value IS NULL)",
              f"(SELECT count(*) FROM (SELECT value, lag(value) OVER (ORDER BY event_id) AS p FROM {GAPPY}) WHERE value IS NULL AND p IS NULL)")),
    "check_new_nulls": (
        run(events, lambda s, d: C.change_column_type(t(s, d, "events").withColumn("value", F.expr("if(event_type = 'view', 'x', CAST(value AS string))")), "value", "float"),
            {"type": "convert_type", "target_columns": ["value"]}, ["new_nulls_introduced"]),
        issue("new_nulls_introduced", "warning", "value", "new null values", "0", "(SELECT count(*) FROM events WHERE event_type = 'view')")),
    "check_drop_rows_nulls": (
        run(gappy_events, gappy_events, {"type": "drop_rows", "conditions": [{"column": "value", "operator": "isnull"}]}, ["drop_rows_null_check"]),
        issue("drop_rows_null_check", "warning", "value", "null rows remain", "NULL", f"(SELECT count(*) FROM {GAPPY} WHERE value IS NULL)")),
    "check_deduplicate": (
        run(lambda s, d: t(s, d, "documents").select("doc_id", "text"), lambda s, d: t(s, d, "documents").select("doc_id", "text"), {"type": "deduplicate", "target_columns": ["text"]}, ["deduplicate_success"]),
        issue("deduplicate_success", "warning", None, "duplicates remain", "n", "n", "FROM (SELECT count(*) - count(DISTINCT text) AS n FROM documents)")),
    "check_new_duplicates": (
        run(lambda s, d: t(s, d, "part").select("p_name", "p_brand", "p_partkey"), lambda s, d: t(s, d, "part").selectExpr("p_name", "p_brand", "p_partkey - p_partkey AS p_partkey"),
            {"type": "replace_values"}, ["new_duplicates_check"]),
        issue("new_duplicates_check", "warning", None, "new duplicate rows", "0", "(SELECT count(*) FROM part) - (SELECT count(*) FROM (SELECT DISTINCT p_name, p_brand FROM part))")),
    "check_join_duplicates": (
        run(lambda s, d: t(s, d, "customer"), lambda s, d: J.join_tables(t(s, d, "customer"), t(s, d, "orders"), "c_custkey", "o_custkey"), {"type": "join"}, ["join_duplicates"]),
        issue("join_duplicates", "warning", None, "the join multiplied rows", "(SELECT count(*) FROM customer)", "(SELECT count(*) FROM customer LEFT JOIN orders ON c_custkey = o_custkey)")),
    "check_numeric_bounds": (
        run(lambda s, d: t(s, d, "customer"), lambda s, d: t(s, d, "customer").withColumn("c_acctbal", F.col("c_acctbal") / 5000), {"type": "normalize", "target_columns": ["c_acctbal"]}, ["numeric_bounds"]),
        issue("numeric_bounds", "warning", "c_acctbal", "values outside [0, 1]", "min(c_acctbal) / 5000", "max(c_acctbal) / 5000", "FROM customer")),
    "check_value_changes": (
        run(orders, lambda s, d: X.replace_values(t(s, d, "orders"), ["o_orderstatus"], "Z", "Y"), {"type": "replace_values", "target_columns": ["o_orderstatus"], "parameters": {"old_value": "Z"}}, ["value_changes"]),
        issue("value_changes", "info", None, "nothing was replaced", "NULL", "(SELECT count(*) FROM orders WHERE o_orderstatus = 'Z')")),
    "check_sort_order": (
        run(orders, orders, {"type": "sort_rows", "target_columns": ["o_totalprice"], "parameters": {"order_by": ["o_orderkey"]}}, ["sort_order_valid"]),
        issue("sort_order_valid", "info", "o_totalprice", "not sorted by the first key", "NULL",
              "(SELECT count(*) FROM (SELECT o_totalprice AS v, lag(o_totalprice) OVER (ORDER BY o_orderkey) AS p FROM orders) WHERE v < p)")),
    "check_phone_format": (
        run(phones, lambda s, d: M.format_phone_columns(phones(s, d), ["phone"]), {"type": "format_phone", "target_columns": ["phone"]}, ["phone_format_valid"]),
        issue("phone_format_valid", "warning", "phone", "phone numbers do not have the layout", "0", "(SELECT count(*) FROM customer WHERE c_custkey % 6 IN (0, 1, 2))")),
    "check_aggregation_values": (
        run(lambda s, d: gappy_orders(s, d), lambda s, d: G.group_by(gappy_orders(s, d), ["o_orderstatus"], {"o_custkey": "sum"}), {"type": "group_by", "parameters": {"aggregations": {"o_custkey": "sum"}}},
            ["aggregation_values"]),
        issue("aggregation_values", "info", "o_custkey", "the total changed", "(SELECT sum(o_custkey) FROM orders)", f"(SELECT sum(o_custkey) FROM {GAPPY_ORDERS} WHERE o_orderstatus IS NOT NULL)")),
    "accept_column_format": (
        run(phones, lambda s, d: M.format_phone(phones(s, d), "phone"), {"type": "x", "acceptance_criteria": [
            {"type": "column_format", "column": "phone", "pattern": r"\(\d{3}\) \d{3}-\d{4}", "min_match_rate": 0.9}]}),
        issue("acceptance_column_format", "error", "phone", "too few values have the format", "0.9", "count(*) FILTER (c_custkey % 6 < 4) / (count(*) FILTER (c_custkey % 6 < 5))::DOUBLE", "FROM customer")),
    "accept_value_changed": (
        run(orders, lambda s, d: M.change_case(t(s, d, "orders"), ["o_orderpriority"], "upper"), {"type": "x", "acceptance_criteria": [
            {"type": "value_changed", "column": "o_orderpriority", "key": ["o_orderkey"]}, {"type": "value_changed", "column": "o_totalprice", "key": "o_orderkey"}]}),
        issue("acceptance_value_changed", "error", "o_orderpriority", "no value changed", "NULL", "(SELECT count(*) FROM orders WHERE upper(o_orderpriority) <> o_orderpriority)") + " UNION ALL " +
        issue("acceptance_value_changed", "error", "o_totalprice", "no value changed", "NULL", "0")),
    "accept_row_count": (
        run(orders, lambda s, d: t(s, d, "orders").where("o_orderstatus = 'F'"), {"type": "x", "acceptance_criteria": [{"type": "row_count_change", "expected_change": "increase"},
                                                                                                                  {"type": "row_count_change", "expected_change": "decrease"}]}),
        issue("acceptance_row_count_change", "error", None, "row count should increase", N, "(SELECT count(*) FROM orders WHERE o_orderstatus = 'F')")),
    "accept_column_exists": (
        run(orders, orders, {"type": "x", "acceptance_criteria": [{"type": "column_exists", "column": "o_custkey", "should_exist": False}, {"type": "column_exists", "column": "o_orderkey"}]}),
        issue("acceptance_column_exists", "error", "o_custkey", "column presence is wrong", "NULL", "NULL")),
    "accept_no_nulls": (
        run(gappy_events, gappy_events, {"type": "x", "acceptance_criteria": [{"type": "no_nulls", "column": "value"}, {"type": "no_nulls", "column": "event_id"}]}),
        issue("acceptance_no_nulls", "error", "value", "nulls remain", "NULL", f"(SELECT count(*) FROM {GAPPY} WHERE value IS NULL)")),
    "accept_unique_values": (
        run(orders, orders, {"type": "x", "acceptance_criteria": [{"type": "unique_values", "column": "o_custkey"}, {"type": "unique_values", "column": "o_orderkey"}]}),
        issue("acceptance_unique_values", "error", "o_custkey", "values repeat", "NULL", "(SELECT count(*) - count(DISTINCT o_custkey) FROM orders)")),
    "validate_summary": (
        lambda s, d: H.summarize(H.validate(t(s, d, "orders"), t(s, d, "orders").where("o_totalprice < 20000"), {"type": "filter_rows", "acceptance_criteria": [
            {"type": "row_count_change", "expected_change": "same"}]})),
        "SELECT false AS passed, 'error' AS severity, 1::BIGINT AS errors, 1::BIGINT AS warnings, 0::BIGINT AS infos, 'row count should same' AS suggestion FROM orders HAVING count(*) > 0"),
    "risk_filter": (
        lambda s, d: H.assess_risk(t(s, d, "orders"), {"type": "filter_rows", "conditions": [{"column": "o_orderstatus", "operator": "eq", "value": "F"}]}, True),
        """SELECT count(*) AS rows_before, count(*) FILTER (o_orderstatus = 'F') AS rows_after, round_even(count(*) FILTER (o_orderstatus <> 'F') * 100.0::DOUBLE / count(*), 1) AS removal_percent,
           'deployed; filter keeps few rows' AS reasons, 'high' AS risk_level FROM orders"""),
    "risk_deduplicate": (
        lambda s, d: H.assess_risk(t(s, d, "events"), {"type": "deduplicate", "target_columns": ["user_id"]}),
        """SELECT count(*) AS rows_before, count(DISTINCT user_id) AS rows_after, round_even((count(*) - count(DISTINCT user_id)) * 100.0::DOUBLE / count(*), 1) AS removal_percent,
           'removes many rows' AS reasons, 'moderate' AS risk_level FROM events"""),
    "risk_removed_sample": (
        lambda s, d: H.removed_sample(t(s, d, "orders"), {"type": "drop_rows", "conditions": [{"column": "o_orderstatus", "operator": "eq", "value": "F"}]}, 3),
        "SELECT * FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey, o_custkey LIMIT 3"),
}
