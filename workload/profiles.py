"""Profiles, contracts and matching."""

from pyspark.sql import functions as F

from cleanloom.plans import contract as N, profile as P

from .base import CUSTOMER_ORDERS, GAPPY, customer_orders, gappy_events, t


def messy_customers(s, d):
    """customers with mail, phone, casing, blanks and edge spaces"""
    return t(s, d, "customer").selectExpr(
        "c_custkey AS customer_id", "CASE WHEN c_custkey % 10 = 0 THEN 'none' ELSE concat('c', c_custkey, '@mail.example') END AS email",
        "CASE c_custkey % 4 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN concat(' ', c_mktsegment) ELSE c_mktsegment END AS segment",
        "CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN '' ELSE c_name END AS full_name", "c_acctbal AS balance")


MESSY = """(SELECT c_custkey AS customer_id, CASE WHEN c_custkey % 10 = 0 THEN 'none' ELSE 'c' || c_custkey || '@mail.example' END AS email,
  CASE c_custkey % 4 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN ' ' || c_mktsegment ELSE c_mktsegment END AS segment,
  CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN '' ELSE c_name END AS full_name, c_acctbal AS balance FROM customer)"""


def text_profile_sql(c, kind, source, dtype="object"):
    return f"""SELECT '{c}' AS "column", '{dtype}' AS dtype, '{kind}' AS semantic_type, count(*) AS row_count, count(*) - count({c}) AS null_count,
      round_even((count(*) - count({c})) * 100 / count(*)::DOUBLE, 2) AS null_percent, count(*) FILTER ({c} = '') AS empty_string_count,
      count(*) FILTER ({c} <> trim({c})) AS edge_whitespace_count, count(DISTINCT {c}) AS unique_count, count(DISTINCT lower({c})) AS unique_lower_count FROM {source}"""


def statistics_sql(c, source):
    return f"""SELECT '{c}' AS "column", min(x) AS min_value, max(x) AS max_value, round_even(avg(x), 4) AS mean, round_even(quantile_cont(x, 0.5), 4) AS median, round_even(stddev_samp(x), 4) AS std,
      round_even(quantile_cont(x, 0.25), 4) AS q1, round_even(quantile_cont(x, 0.75), 4) AS q3, round_even(skewness(x), 4) AS skewness,
      (SELECT count(*) FROM {source}, (SELECT quantile_cont({c}::DOUBLE, 0.25) AS a, quantile_cont({c}::DOUBLE, 0.75) AS b FROM {source})
       WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS outlier_count,
      round_even(quantile_cont(x, 0.25) - 1.5 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)), 4) AS lower_bound,
      round_even(quantile_cont(x, 0.75) + 1.5 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)), 4) AS upper_bound
      FROM (SELECT {c}::DOUBLE AS x FROM {source})"""


def incoming(s, d):
    """the columns of four tables offered to the contract of customer"""
    sides = {
        "same": t(s, d, "customer"),
        "renamed": t(s, d, "customer").toDF("C_CUSTKEY", "C-Name", "c_nation_key", "c_acct_bal", "c_mktsegment"),
        "fewer": t(s, d, "customer").select("c_custkey", "c_name", "c_nationkey"),
        "other": t(s, d, "events"),
    }
    return P.meanings_of(sides).withColumn("contract_id", F.lit("customers"))


def contract(s, d):
    return N.generate_contract(P.profile_table(t(s, d, "customer"), quartiles=False), "customers")


CUSTOMER_COLUMNS = [("c_custkey", "phone", "int64"), ("c_name", "name", "object"), ("c_nationkey", "numeric", "int64"), ("c_acctbal", "numeric", "float64"), ("c_mktsegment", "category", "object")]
EVENT_COLUMNS = [("event_id", "id", "int64"), ("ts", "datetime", "datetime64[ns]"), ("user_id", "phone", "int64"), ("event_type", "category", "object"), ("value", "numeric", "float64"), ("props", "unknown", "object")]
ORDER_COLUMNS = [("o_orderkey", "phone", "int64"), ("o_custkey", "phone", "int64"), ("o_orderstatus", "category", "object"), ("o_totalprice", "numeric", "float64"),
                 ("o_orderdate", "datetime", "datetime64[ns]"), ("o_orderpriority", "category", "object")]
SUPPLIER_COLUMNS = [("s_suppkey", "phone", "int64"), ("s_name", "name", "object"), ("s_nationkey", "numeric", "int64"), ("s_acctbal", "numeric", "float64")]
NATION_COLUMNS = [("n_nationkey", "numeric", "int64"), ("n_name", "name", "object"), ("n_regionkey", "numeric", "int64")]
PART_COLUMNS = [("p_partkey", "phone", "int64"), ("p_name", "name", "object"), ("p_brand", "unknown", "object"), ("p_type", "category", "object"), ("p_size", "phone", "int64"), ("p_retailprice", "numeric", "float64")]
RENAMED = ("C_CUSTKEY", "C-Name", "c_nation_key", "c_acct_bal", "c_mktsegment")


def columns_sql(files):
    """rows (file, pos, src, col, kind, dtype); a column's values are those of the column ``src``"""
    rows = [(f, i, c, n, k, t) for f, columns, names in files for i, ((c, k, t), n) in enumerate(zip(columns, names or [c for c, *_ in columns]))]
    return "(VALUES " + ", ".join(f"('{f}', {i}, '{c}', '{n}', '{k}', '{t}')" for f, i, c, n, k, t in rows) + ") v(file, pos, src, col, kind, dtype)"


def matching_sql(files, targets, tables, weights=(0.5, 0.3, 0.2, 0.4)):
    """CTEs: ``sc``, the scores of all pairs of columns, and ``m``, the greedy mapping of each file in the order of its columns"""
    norm = "replace(replace(replace(replace(lower({0}), ' ', ''), '_', ''), '-', ''), '.', '')"
    sets = " UNION ".join(f"SELECT '{c}' AS src, lower(trim({c}::VARCHAR)) AS v FROM {table} WHERE {c} IS NOT NULL" for table, columns in tables for c, *_ in columns)
    w_name, w_type, w_value, floor = weights
    return f"""WITH RECURSIVE inc AS (SELECT *, {norm.format('col')} AS n FROM {columns_sql(files)}), con AS (SELECT *, {norm.format('col')} AS n FROM {columns_sql(targets)}),
      vals AS ({sets}), size AS (SELECT src, count(*) AS k FROM vals GROUP BY 1),
      shared AS (SELECT a.src AS x, b.src AS y, count(*) AS k FROM vals a JOIN vals b USING (v) GROUP BY 1, 2),
      grp AS (SELECT * FROM (VALUES ('id', 'identifiers'), ('numeric', 'identifiers'), ('phone', 'contact'), ('datetime', 'temporal'), ('numeric', 'numeric'), ('name', 'text'), ('category', 'text'), ('unknown', 'text')) g(kind, g)),
      reads AS (SELECT * FROM (VALUES ('int64', 'float64'), ('int64', 'object'), ('float64', 'int64'), ('float64', 'object'), ('datetime64[ns]', 'object')) r(x, y)),
      p AS (SELECT i.file, i.pos, i.col AS incoming, c.pos AS place, c.col AS target, c.file AS target_file, i.kind AS k1, c.kind AS k2,
              CASE WHEN i.col = c.col THEN 1.0::DOUBLE WHEN i.n = c.n THEN 0.95 ELSE 1 - levenshtein(i.n, c.n) / greatest(length(i.n), length(c.n))::DOUBLE END AS sim,
              CASE WHEN i.col = c.col THEN 'exact' WHEN i.n = c.n THEN 'normalized' END AS same,
              coalesce(s.k, 0)::DOUBLE / nullif(a.k + b.k - coalesce(s.k, 0), 0) AS overlap,
              i.kind = 'unknown' OR c.kind = 'unknown' OR i.kind = c.kind OR EXISTS (SELECT 1 FROM grp g JOIN grp h USING (g) WHERE g.kind = i.kind AND h.kind = c.kind) AS type_ok,
              i.dtype = c.dtype OR EXISTS (SELECT 1 FROM reads r WHERE r.x = i.dtype AND r.y = c.dtype) AS dtype_ok
            FROM inc i, con c LEFT JOIN size a ON a.src = i.src LEFT JOIN size b ON b.src = c.src LEFT JOIN shared s ON s.x = i.src AND s.y = c.src),
      sc AS (SELECT *, coalesce(same, CASE WHEN sim >= 0.7 THEN 'fuzzy' ELSE 'weak' END) AS match_type, CASE WHEN same IS NOT NULL THEN sim WHEN sim >= 0.7 THEN sim * 0.9 ELSE sim * 0.5 END AS name_score,
              CASE WHEN k1 = k2 THEN 1.0::DOUBLE WHEN k1 = 'unknown' OR k2 = 'unknown' THEN 0.5 WHEN type_ok THEN 0.7 ELSE 0.2 END AS type_score FROM p),
      st AS (SELECT *, name_score * {w_name} + type_score * {w_type} + coalesce(overlap, 0) * {w_value} AS score FROM sc),
      cand AS (SELECT file, pos, any_value(incoming) AS incoming, coalesce(list({{'target': target, 'score': score, 'match_type': match_type, 'type_ok': type_ok, 'dtype_ok': dtype_ok}} ORDER BY score DESC, place) FILTER (score > {floor}), []) AS c FROM st GROUP BY 1, 2),
      g AS (SELECT DISTINCT file, -1 AS pos, NULL::VARCHAR AS incoming, []::VARCHAR[] AS taken, NULL::STRUCT(target VARCHAR, score DOUBLE, match_type VARCHAR, type_ok BOOLEAN, dtype_ok BOOLEAN) AS best FROM inc
        UNION ALL SELECT file, pos, incoming, CASE WHEN b IS NULL THEN taken ELSE list_append(taken, b.target) END, b
          FROM (SELECT g.file, cand.pos, cand.incoming, g.taken, list_filter(cand.c, lambda x: NOT list_contains(g.taken, x.target))[1] AS b FROM g JOIN cand ON cand.file = g.file AND cand.pos = g.pos + 1)),
      m AS (SELECT file, pos, incoming, best.target AS target, best.score AS score, best.match_type AS match_type, best.type_ok AS type_ok, best.dtype_ok AS dtype_ok FROM g WHERE pos >= 0)"""


OFFERED = matching_sql([("same", CUSTOMER_COLUMNS, None), ("renamed", CUSTOMER_COLUMNS, RENAMED), ("fewer", CUSTOMER_COLUMNS[:3], None), ("other", EVENT_COLUMNS, None)],
                       [("customers", CUSTOMER_COLUMNS, None)], [("customer", CUSTOMER_COLUMNS), ("events", EVENT_COLUMNS)])
MATCHED = f"""{OFFERED}, t AS (SELECT file, count(target) AS mapped, 5 - count(target) AS missing, coalesce(avg(score), 0) AS mean FROM m GROUP BY 1),
  r AS (SELECT *, least(100, greatest(0, (5 - missing) / 5.0::DOUBLE * 60 + mean * 40 - missing * 15)) AS score FROM t)"""


def score_sides(s, d):
    """columns of five small tables offered to the contract of customer, whose value sketches are exact"""
    c = t(s, d, "customer")
    sides = {"same": c, "renamed": c.toDF(*RENAMED), "fewer": c.select("c_custkey", "c_name", "c_nationkey"), "supplier": t(s, d, "supplier"), "nation": t(s, d, "nation")}
    return P.meanings_of(sides).withColumn("contract_id", F.lit("customers"))


NUMBERS = ("min_value", "max_value", "mean", "median", "std", "q1", "q3", "skewness", "outlier_count", "lower_bound", "upper_bound")
LAYOUTS = {"phone": "+X XXX XXX XXXX", "datetime": "YYYY-MM-DD HH:MM:SS"}


def profile_column_sql(table, i, c, kind, dtype):
    """every metric of one column of a table without nulls"""
    x, text = f"{c}::DOUBLE", dtype == "object"
    shown = "true" if kind == "category" else "unique_count < 50" if text else "false"
    a, b = f"quantile_cont({x}, 0.25)", f"quantile_cont({x}, 0.75)"
    numbers = f"(SELECT {', '.join(f'NULL::DOUBLE AS {n}' if n != 'outlier_count' else 'NULL::BIGINT AS outlier_count' for n in NUMBERS)})"
    if dtype in ("int64", "float64"):
        numbers = f"""(SELECT min({x}) AS min_value, max({x}) AS max_value, round_even(avg({x}), 4) AS mean, round_even(quantile_cont({x}, 0.5), 4) AS median, round_even(stddev_samp({x}), 4) AS std,
          round_even({a}, 4) AS q1, round_even({b}, 4) AS q3, round_even(skewness({x}), 4) AS skewness, (SELECT count(*) FROM {table}, (SELECT {a} AS a, {b} AS b FROM {table}) f WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS outlier_count,
          round_even({a} - 1.5 * ({b} - {a}), 4) AS lower_bound, round_even({b} + 1.5 * ({b} - {a}), 4) AS upper_bound FROM {table})"""
    top = f"""(SELECT string_agg(v || ':' || n, '|' ORDER BY n DESC, v) FROM (SELECT {c} AS v, count(*) AS n FROM {table} GROUP BY 1 ORDER BY n DESC, v LIMIT 10))"""
    layout = f"'{LAYOUTS[kind]}'" if kind in LAYOUTS else "NULL::VARCHAR"
    return f"""SELECT {i}::INTEGER AS position, '{c}' AS "column", '{dtype}' AS dtype, '{kind}' AS semantic_type, {layout} AS detected_pattern, b.*, s.*, CASE WHEN {shown} THEN {top} END AS top_values,
      CASE WHEN {shown} THEN CASE WHEN unique_count <= 10 THEN 'low' WHEN unique_count <= 100 THEN 'medium' ELSE 'high' END END AS cardinality,
      CASE WHEN {shown} THEN unique_count <= 10 OR unique_count <= 100 AND unique_count / row_count < 0.5 END AS is_categorical
      FROM (SELECT count(*) AS row_count, 0::BIGINT AS null_count, 0.0::DOUBLE AS null_percent, {f"count(*) FILTER ({c} = '')" if text else "0::BIGINT"} AS empty_string_count,
        {f"count(*) FILTER ({c} <> '' AND trim({c}) = '')" if text else "0::BIGINT"} AS whitespace_only_count, {f"count(*) FILTER ({c} <> trim({c}))" if text else "0::BIGINT"} AS edge_whitespace_count,
        count(DISTINCT {c}) AS unique_count, count(DISTINCT lower({c}::VARCHAR)) AS unique_lower_count, count(DISTINCT {c}) = count(*) AND count(*) > 1 AS is_unique, count(*) AS invalid_email_count,
        least(5, count(DISTINCT {c}))::INTEGER AS n_samples FROM {table}) b, {numbers} s"""


def all_metrics(profile):
    return profile.drop("values_sketch").withColumns({"n_samples": F.size("sample_values"), "top_values": F.array_join(F.transform("top_values", lambda v: F.concat_ws(":", v["value"], v["count"])), "|")}).drop("sample_values")


def many_tables(s, d):
    """five tables profiled in one job"""
    return all_metrics(P.profile_tables({n: t(s, d, n) for n in ("customer", "orders", "supplier", "nation", "part")}))


def chain(s, d):
    """can orders or customer (sources) feed orders (target)?"""
    o = N.generate_contract(P.profile_table(t(s, d, "orders"), quartiles=False), "orders")
    c = N.generate_contract(P.profile_table(t(s, d, "customer"), quartiles=False), "customers")
    pairs = o.withColumn("target_id", F.lit("orders")).unionByName(c.withColumn("target_id", F.lit("orders")))
    return N.match_contracts(pairs, o).selectExpr("source_id", "target_id", "size(mappings) AS mapped", "bround(score, 2) AS score", "is_chainable")


Q = {
    "profile_table_text": (
        lambda s, d: P.profile_table(messy_customers(s, d).select("email", "segment", "full_name")).select(
            "column", "dtype", "semantic_type", "row_count", "null_count", "null_percent", "empty_string_count", "edge_whitespace_count", "unique_count", "unique_lower_count"),
        " UNION ALL ".join(text_profile_sql(c, k, MESSY) for c, k in (("email", "email"), ("segment", "category"), ("full_name", "name")))),
    "profile_table_all": (lambda s, d: all_metrics(P.profile_table(t(s, d, "orders"))), " UNION ALL ".join(profile_column_sql("orders", i, *c) for i, c in enumerate(ORDER_COLUMNS))),
    "profile_many_tables": (
        many_tables,
        " UNION ALL ".join(f"SELECT '{n}' AS file, * FROM ({profile_column_sql(n, i, *c)})" for n, columns in (
            ("customer", CUSTOMER_COLUMNS), ("orders", ORDER_COLUMNS), ("supplier", SUPPLIER_COLUMNS), ("nation", NATION_COLUMNS), ("part", PART_COLUMNS)) for i, c in enumerate(columns))),
    "profile_semantic_types": (
        lambda s, d: P.profile_table(t(s, d, "orders").selectExpr(
            "o_orderkey AS order_id", "date_format(o_orderdate, 'yyyy-MM-dd') AS day", "o_orderdate AS placed", "concat('https://shop.example/', o_orderkey) AS link",
            "concat('$', format_string('%.2f', o_totalprice)) AS paid", "concat(pmod(o_custkey, 100), '%') AS share", "CASE WHEN o_orderstatus = 'O' THEN 'Yes' ELSE 'no' END AS open",
            "o_orderstatus AS status", "o_totalprice AS price", "concat('555-010-', lpad(CAST(pmod(o_orderkey, 10000) AS string), 4, '0')) AS tel", "lpad(CAST(pmod(o_custkey, 90000) AS string), 5, '0') AS zip",
            "date_format(o_orderdate, 'HH:mm:ss') AS clock", "CAST(NULL AS string) AS nothing")).select("column", "semantic_type", "detected_pattern"),
        """SELECT c AS "column", k AS semantic_type, p AS detected_pattern FROM (VALUES ('order_id', 'id', NULL), ('day', 'date', 'YYYY-MM-DD'), ('placed', 'datetime', 'YYYY-MM-DD HH:MM:SS'),
           ('link', 'url', 'https://...'), ('paid', 'currency', '$X,XXX.XX'), ('share', 'percentage', 'XX.X%'), ('open', 'boolean', 'true/false'), ('status', 'category', NULL),
           ('price', 'numeric', NULL), ('tel', 'phone', '(XXX) XXX-XXXX'), ('zip', 'zipcode', 'XXXXX or XXXXX-XXXX'), ('clock', 'time', 'HH:MM:SS'), ('nothing', 'unknown', NULL)) v(c, k, p)
           WHERE (SELECT count(*) FROM orders) > 0"""),
    "profile_statistics": (
        lambda s, d: P.statistics(gappy_events(s, d), ["value", "user_id"]), statistics_sql("value", GAPPY) + " UNION ALL " + statistics_sql("user_id", GAPPY)),
    "profile_top_values": (
        lambda s, d: P.top_values(P.value_counts(t(s, d, "documents"), ["lang", "source"]), t(s, d, "documents").agg(F.count(F.lit(1)).alias("n")).scalar()).selectExpr(
            "`column`", "inline(top_values)").selectExpr("`column`", "CAST(rank AS bigint) AS rank", "value", "count", "percent"),
        """WITH c AS (SELECT 'lang' AS "column", lang AS value, count(*) AS count FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2),
           r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS rank FROM c)
           SELECT "column", rank, value, count, round_even(count * 100 / (SELECT count(*) FROM documents)::DOUBLE, 1) AS percent FROM r WHERE rank <= 10"""),
    "profile_issues": (
        lambda s, d: P.column_issues(P.profile_table(messy_customers(s, d))),
        f"""SELECT 'email' AS "column", 'invalid_values' AS issue, 'warning' AS severity, count(*) FILTER (email = 'none') AS affected FROM {MESSY}
            UNION ALL SELECT 'segment', 'whitespace', 'warning', count(*) FILTER (starts_with(segment, ' ')) FROM {MESSY}
            UNION ALL SELECT 'segment', 'inconsistent_casing', 'warning', count(DISTINCT segment) - count(DISTINCT lower(segment)) FROM {MESSY}
            UNION ALL SELECT 'full_name', 'missing_values', 'warning', count(*) - count(full_name) FROM {MESSY}
            UNION ALL SELECT 'full_name', 'empty_strings', 'warning', count(*) FILTER (full_name = '') FROM {MESSY}"""),
    "casing_examples": (
        lambda s, d: P.casing_examples(messy_customers(s, d), "segment").selectExpr("low", "concat_ws('|', variants) AS variants"),
        f"""WITH c AS (SELECT segment, count(*) AS n FROM {MESSY} GROUP BY 1), g AS (SELECT lower(segment) AS low, sum(n) AS n, count(*) AS k, string_agg(segment, '|' ORDER BY segment) AS variants FROM c GROUP BY 1)
            SELECT low, variants FROM g WHERE k > 1 ORDER BY n DESC, low LIMIT 3"""),
    "table_summary": (
        lambda s, d: P.table_summary(customer_orders(s, d).select("c_mktsegment", "o_orderstatus", "o_orderpriority")),
        f"""WITH c AS (SELECT c_mktsegment, o_orderstatus, o_orderpriority, count(*) AS n FROM {CUSTOMER_ORDERS} GROUP BY ALL)
           SELECT sum(n)::BIGINT AS row_count, 3::INTEGER AS column_count, (sum(n) - count(*))::BIGINT AS duplicate_rows, (sum(n) FILTER (o_orderstatus IS NOT NULL))::BIGINT AS complete_rows, 'critical' AS severity FROM c"""),
    "generate_contract": (
        lambda s, d: contract(s, d).selectExpr("name", "semantic_type", "dtype", "required", "nullable", "max_null_percent", "min_value", "max_value", "array_join(array_sort(allowed_values), '|') AS allowed_values",
                                               "array_contains(alternative_names, upper(name)) AS has_upper"),
        """SELECT 'c_custkey' AS name, 'phone' AS semantic_type, 'int64' AS dtype, true AS required, false AS nullable, 10.0::DOUBLE AS max_null_percent, min(c_custkey)::DOUBLE AS min_value,
           max(c_custkey)::DOUBLE AS max_value, NULL::VARCHAR AS allowed_values, true AS has_upper FROM customer
           UNION ALL SELECT 'c_name', 'name', 'object', true, false, 10, NULL, NULL, NULL, true
           UNION ALL SELECT 'c_nationkey', 'numeric', 'int64', true, false, 10, min(c_nationkey), max(c_nationkey), NULL, true FROM customer
           UNION ALL SELECT 'c_acctbal', 'numeric', 'float64', true, false, 10, min(c_acctbal), max(c_acctbal), NULL, true FROM customer
           UNION ALL SELECT 'c_mktsegment', 'category', 'object', true, false, 10, NULL, NULL, string_agg(DISTINCT c_mktsegment, '|' ORDER BY c_mktsegment), true FROM customer"""),
    "contract_fingerprint": (
        lambda s, d: N.fingerprint(contract(s, d)),
        """SELECT 'customers' AS contract_id, left(sha256('c_custkey:phone:int64|c_name:name:object|c_nationkey:numeric:int64|c_acctbal:numeric:float64|c_mktsegment:category:object'), 16) AS fingerprint
           FROM customer HAVING count(*) > 0"""),
    "match_scores": (
        lambda s, d: N.column_scores(score_sides(s, d), contract(s, d)).selectExpr(
            "file", "incoming", "target", "bround(name_score, 6) AS name_score", "match_type", "type_score", "bround(value_overlap, 6) AS value_overlap", "bround(score, 6) AS score", "type_ok", "dtype_ok"),
        matching_sql([("same", CUSTOMER_COLUMNS, None), ("renamed", CUSTOMER_COLUMNS, RENAMED), ("fewer", CUSTOMER_COLUMNS[:3], None), ("supplier", SUPPLIER_COLUMNS, None), ("nation", NATION_COLUMNS, None)],
                     [("customers", CUSTOMER_COLUMNS, None)], [("customer", CUSTOMER_COLUMNS), ("supplier", SUPPLIER_COLUMNS), ("nation", NATION_COLUMNS)])
        + """ SELECT file, incoming, target, round_even(name_score, 6) AS name_score, match_type, type_score, round_even(coalesce(overlap, 0), 6) AS value_overlap, round_even(score, 6) AS score, type_ok, dtype_ok FROM st"""),
    "match_schema": (
        lambda s, d: N.match_schema(incoming(s, d), contract(s, d)).selectExpr("file", "size(mappings) AS mapped", "size(missing_required) AS missing", "bround(score, 4) AS score", "level", "is_compatible", "auto_processable"),
        MATCHED + """ SELECT file, mapped::INTEGER AS mapped, missing::INTEGER AS missing, round_even(score, 4) AS score, CASE WHEN score >= 85 THEN 'HIGH' WHEN score >= 60 THEN 'MEDIUM' WHEN score >= 40 THEN 'LOW' ELSE 'NO_MATCH' END AS level,
           score >= 40 AS is_compatible, score >= 85 AS auto_processable FROM r"""),
    "match_mappings": (
        lambda s, d: N.match_schema(incoming(s, d), contract(s, d)).selectExpr("file", "inline(mappings)").selectExpr("file", "incoming", "target", "bround(score, 4) AS score", "match_type", "type_ok", "dtype_ok"),
        OFFERED + " SELECT file, incoming, target, round_even(score, 4) AS score, match_type, type_ok, dtype_ok FROM m WHERE target IS NOT NULL"),
    "match_discrepancies": (
        lambda s, d: N.discrepancies(N.match_schema(incoming(s, d), contract(s, d))).drop("contract_id"),
        OFFERED + """ SELECT file, 'type_mismatch' AS kind, 'warning' AS severity, incoming AS "column" FROM m WHERE NOT type_ok
           UNION ALL SELECT f.file, 'missing_required', 'critical', con.col FROM (SELECT DISTINCT file FROM inc) f, con WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.file = f.file AND m.target = con.col)
           UNION ALL SELECT file, 'extra_column', 'info', incoming FROM m WHERE target IS NULL"""),
    "match_contracts": (
        chain,
        matching_sql([("orders", ORDER_COLUMNS, None), ("customers", CUSTOMER_COLUMNS, None)], [("orders", ORDER_COLUMNS, None)], [("orders", ORDER_COLUMNS), ("customer", CUSTOMER_COLUMNS)], (0.6, 0.4, 0.0, 0.5))
        + """ SELECT file AS source_id, 'orders' AS target_id, count(target)::INTEGER AS mapped, round_even(count(target) * 100.0::DOUBLE / 6, 2) AS score, count(target) = 6 AS is_chainable FROM m GROUP BY 1"""),
}
