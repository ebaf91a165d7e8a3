"""Text, format and date operators."""

from cleanloom.operators import dates as D, format as M, text as X

from .base import GAPPY_ORDERS, gappy_orders, t
from .columns import mixed_dates

PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def phones(s, d):
    """phone numbers in six layouts made of the customer key"""
    return t(s, d, "customer").selectExpr("c_custkey", """CASE pmod(c_custkey, 6)
        WHEN 0 THEN concat('(555) 010-', lpad(CAST(pmod(c_custkey, 10000) AS string), 4, '0'))
        WHEN 1 THEN concat('+1 555.020.', lpad(CAST(pmod(c_custkey, 10000) AS string), 4, '0'))
        WHEN 2 THEN concat('555030', lpad(CAST(pmod(c_custkey, 10000) AS string), 4, '0'))
        WHEN 3 THEN concat('0044 555 040 ', lpad(CAST(pmod(c_custkey, 10000) AS string), 4, '0'))
        WHEN 4 THEN 'ext. 12' ELSE NULL END AS phone""")


LAST4 = "lpad((c_custkey % 10000)::VARCHAR, 4, '0')"


def phone_sql(parts, keep_long):
    long_case = parts.format("'555'", "'040'") if keep_long else "'0044 555 040 ' || " + LAST4
    return f"""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN {parts.format("'555'", "'010'")} WHEN 1 THEN {parts.format("'555'", "'020'")}
        WHEN 2 THEN {parts.format("'555'", "'030'")} WHEN 3 THEN {long_case} WHEN 4 THEN 'ext. 12' END AS phone FROM customer"""


def ordered_lines(s, d):
    o, li = t(s, d, "orders").select("o_orderkey", "o_orderdate"), t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    return o.join(li, o.o_orderkey == li.l_orderkey).drop("o_orderkey").selectExpr("*", "o_orderdate + make_dt_interval(0, l_linenumber * 3, 7, 0) AS placed").drop("o_orderdate")


LINES = """(SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, o_orderdate + to_hours(l_linenumber * 3) + to_minutes(7) AS placed
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
SPAN = "(epoch_us(l_shipdate) - epoch_us(placed))"

Q = {
    "change_case_lower": (
        lambda s, d: M.change_case(t(s, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus"), ["o_orderpriority", "o_orderstatus", "o_orderkey", "nope"], "lower"),
        "SELECT o_orderkey, lower(o_orderpriority) AS o_orderpriority, lower(o_orderstatus) AS o_orderstatus FROM orders"),
    "find_replace": (
        lambda s, d: X.find_replace(t(s, d, "part").select("p_partkey", "p_name"), "p_name", "ring", "R$1"), "SELECT p_partkey, replace(p_name, 'ring', 'R$1') AS p_name FROM part"),
    "find_replace_ignore_case": (
        lambda s, d: X.find_replace(t(s, d, "documents").select("doc_id", "text"), "text", "The.", "[$0]", case_sensitive=False),
        r"SELECT doc_id, regexp_replace(text, '(?i)The\.', '[$0]', 'g') AS text FROM documents"),
    "find_replace_regex": (
        lambda s, d: X.find_replace(t(s, d, "customer").select("c_custkey", "c_name"), "c_name", r"#0+(\d)", r"-\1", True),
        r"SELECT c_custkey, regexp_replace(c_name, '#0+(\d)', '-\1', 'g') AS c_name FROM customer"),
    "replace_values_cell": (
        lambda s, d: X.replace_values(t(s, d, "orders"), ["o_orderstatus"], "O", "Open"), "SELECT * REPLACE (CASE WHEN o_orderstatus = 'O' THEN 'Open' ELSE o_orderstatus END AS o_orderstatus) FROM orders"),
    "replace_values_regex": (
        lambda s, d: X.replace_values(t(s, d, "orders"), None, r"^\d-", ""), r"SELECT * REPLACE (regexp_replace(o_orderpriority, '^\d-', '', 'g') AS o_orderpriority) FROM orders"),
    "extract_position": (
        lambda s, d: X.extract_text(t(s, d, "customer").select("c_custkey", "c_name"), "c_name", "tail", "position", -4), "SELECT c_custkey, c_name, right(c_name, 4) AS tail FROM customer"),
    "extract_regex": (
        lambda s, d: X.extract_text(t(s, d, "pages").select("page_id", "url"), "url", "lang", "regex", pattern=r"/(en|fr|de)/"),
        "SELECT page_id, url, nullif(regexp_extract(url, '/(en|fr|de)/', 1), '') AS lang FROM pages"),
    "extract_before": (
        lambda s, d: X.extract_text(t(s, d, "pages").select("page_id", "url"), "url", "scheme", "before", delimiter="://"), "SELECT page_id, url, split_part(url, '://', 1) AS scheme FROM pages"),
    "extract_after": (
        lambda s, d: X.extract_text(t(s, d, "pages").select("page_id", "url"), "url", "leaf", "after", delimiter="/"), "SELECT page_id, url, split_part(url, '/', -1) AS leaf FROM pages"),
    "extract_between": (
        lambda s, d: X.extract_text(t(s, d, "pages").select("page_id", "html"), "html", "title", "between", delimiter="<title>", delimiter2="</title>").drop("html"),
        "SELECT page_id, CASE WHEN regexp_matches(html, '<title>(.*?)</title>') THEN regexp_extract(html, '<title>(.*?)</title>', 1) END AS title FROM pages"),
    "extract_pattern": (
        lambda s, d: X.extract_pattern(t(s, d, "events").select("event_id", "props"), ["props"], r"\d+"),
        r"SELECT event_id, props, regexp_extract(props, '\d+') AS props_extracted FROM events"),
    "text_length": (
        lambda s, d: X.text_length(t(s, d, "documents").select("doc_id", "text"), "text", "n").select("doc_id", "n"), "SELECT doc_id, length(text)::INTEGER AS n FROM documents"),
    "text_length_no_spaces": (
        lambda s, d: X.text_length(t(s, d, "documents").select("doc_id", "text"), "text", "n", False).select("doc_id", "n"),
        "SELECT doc_id, length(replace(text, ' ', ''))::INTEGER AS n FROM documents"),
    "pad_text": (
        lambda s, d: X.pad_text(t(s, d, "part").select("p_partkey", "p_size", "p_type"), "p_size", 6), "SELECT p_partkey, lpad(p_size::VARCHAR, 6, '0') AS p_size, p_type FROM part"),
    "pad_text_right": (
        lambda s, d: X.pad_text(t(s, d, "part").select("p_partkey", "p_name"), "p_name", 10, ".", "right"),
        "SELECT p_partkey, CASE WHEN length(p_name) < 10 THEN rpad(p_name, 10, '.') ELSE p_name END AS p_name FROM part"),
    "pad_text_both": (
        lambda s, d: X.pad_text(t(s, d, "part").select("p_partkey", "p_type"), ["p_type"], 11, "*", "both"),
        """SELECT p_partkey, CASE WHEN length(p_type) < 11 THEN repeat('*', ((11 - length(p_type)) // 2 + (11 - length(p_type)) % 2)::INTEGER) || p_type ||
           repeat('*', ((11 - length(p_type)) // 2)::INTEGER) ELSE p_type END AS p_type FROM part"""),
    "remove_characters": (
        lambda s, d: X.remove_characters(t(s, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "-AEIOU"),
        "SELECT o_orderkey, regexp_replace(o_orderpriority, '[-AEIOU]', '', 'g') AS o_orderpriority FROM orders"),
    "remove_digits": (
        lambda s, d: X.remove_characters(t(s, d, "documents").select("doc_id", "text"), "text", remove_type="digits"), r"SELECT doc_id, regexp_replace(text, '\d', '', 'g') AS text FROM documents"),
    "remove_letters": (
        lambda s, d: X.remove_characters(t(s, d, "documents").select("doc_id", "text"), "text", remove_type="letters"), "SELECT doc_id, regexp_replace(text, '[a-zA-Z]', '', 'g') AS text FROM documents"),
    "remove_punctuation": (
        lambda s, d: X.remove_characters(t(s, d, "documents").select("doc_id", "text"), "text", remove_type="punctuation"),
        "SELECT doc_id, translate(text, '" + PUNCT.replace("'", "''") + "', '') AS text FROM documents"),
    "string_contains": (
        lambda s, d: X.string_contains(gappy_orders(s, d).select("o_orderkey", "o_orderstatus"), "o_orderstatus", "f", "hit"),
        f"SELECT o_orderkey, o_orderstatus, coalesce(contains(lower(o_orderstatus), 'f'), false) AS hit FROM {GAPPY_ORDERS}"),
    "string_contains_regex": (
        lambda s, d: X.string_contains(t(s, d, "documents").select("doc_id", "text"), "text", r"\bthe\b.*\d{3}", "hit", regex=True).drop("text"),
        r"SELECT doc_id, regexp_matches(text, '(?i)\bthe\b.*\d{3}') AS hit FROM documents"),
    "substring": (
        lambda s, d: X.substring(t(s, d, "customer").select("c_custkey", "c_name"), "c_name", -9, 4, "mid"), "SELECT c_custkey, c_name, substr(c_name, length(c_name) - 8, 4) AS mid FROM customer"),
    "substring_columns": (
        lambda s, d: X.substring_columns(t(s, d, "part").select("p_partkey", "p_name", "p_brand"), ["p_name"], before=" ", suffix="_head", create_new=True),
        "SELECT p_partkey, p_name, p_brand, split_part(p_name, ' ', 1) AS p_name_head FROM part"),
    "regex_replace": (
        lambda s, d: X.regex_replace(t(s, d, "pages").select("page_id", "url"), "url", r"^(HTTPS?)://(www\.)?", r"\1|", "site", False),
        r"SELECT page_id, url, regexp_replace(url, '(?i)^(HTTPS?)://(www\.)?', '\1|', 'g') AS site FROM pages"),
    "regex_extract": (
        lambda s, d: X.regex_extract(t(s, d, "pages").select("page_id", "url"), "url", r"[?&]page=(\d+)", "page", 1),
        r"SELECT page_id, url, CASE WHEN regexp_matches(url, '[?&]page=(\d+)') THEN regexp_extract(url, '[?&]page=(\d+)', 1) END AS page FROM pages"),
    "clean_text": (
        lambda s, d: X.clean_text(t(s, d, "conversations").select("conv_id", "turn", "text"), ["text"], True, True, True),
        r"SELECT conv_id, turn, lower(regexp_replace(text, '[^a-zA-Z0-9\s.,!?]', '', 'g')) AS text FROM conversations"),
    "remove_html": (
        lambda s, d: X.remove_html(t(s, d, "pages").select("page_id", "html"), ["html"]),
        """SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'),
           '&nbsp;', ' '), '&quot;', '"'), '&#39;', '''') AS html FROM pages"""),
    "standardize": (
        lambda s, d: X.standardize(t(s, d, "part").selectExpr("p_partkey", "concat(' \t', upper(p_name), '\n') AS p_name")), "SELECT p_partkey, lower(p_name) AS p_name FROM part"),
    "mask_last": (
        lambda s, d: X.mask_data(t(s, d, "customer").select("c_custkey", "c_name"), ["c_name"]), "SELECT c_custkey, repeat('*', (length(c_name) - 4)::INTEGER) || right(c_name, 4) AS c_name FROM customer"),
    "mask_middle": (
        lambda s, d: X.mask_data(t(s, d, "part").select("p_partkey", "p_type"), ["p_type"], "middle", 3, "#"),
        """SELECT p_partkey, CASE WHEN length(p_type) <= 6 THEN repeat('#', length(p_type)::INTEGER) ELSE left(p_type, 3) || repeat('#', (length(p_type) - 6)::INTEGER) || right(p_type, 3)
           END AS p_type FROM part"""),
    "mask_email": (
        lambda s, d: X.mask_data(t(s, d, "customer").selectExpr("c_custkey", "CASE WHEN c_custkey % 9 = 0 THEN c_mktsegment ELSE concat(lower(c_mktsegment), c_custkey, '@mail.example') END AS mail"),
                                 ["mail"], "email"),
        """SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN repeat('*', length(c_mktsegment)::INTEGER) ELSE lower(left(c_mktsegment, 1)) ||
           repeat('*', (length(c_mktsegment || c_custkey) - 1)::INTEGER) || '@mail.example' END AS mail FROM customer"""),
    "format_date": (
        lambda s, d: M.format_date(mixed_dates(s, d), "day", "%d/%m/%Y"), "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN strftime(o_orderdate, '%d/%m/%Y') END AS day FROM orders"),
    "format_timestamp": (
        lambda s, d: M.format_date(t(s, d, "events").select("event_id", "ts"), "ts", "%Y-%m-%d at %H:%M:%S, %b"), "SELECT event_id, strftime(ts, '%Y-%m-%d at %H:%M:%S, %b') AS ts FROM events"),
    "format_phone": (lambda s, d: M.format_phone(phones(s, d), "phone"), phone_sql("'(' || {} || ') ' || {} || '-' || " + LAST4, True)),
    "format_phone_country": (
        lambda s, d: M.format_phone(phones(s, d), "phone", "+1 XXX-XXX-XXXX", "49"), phone_sql("'+49 ' || {} || '-' || {} || '-' || " + LAST4, True)),
    "format_phone_columns": (
        lambda s, d: M.format_phone_columns(phones(s, d), ["phone"], "nnn.nnn.nnnn", "1"), phone_sql("'1-' || {} || '.' || {} || '.' || " + LAST4, False)),
    "casing_title": (
        lambda s, d: M.change_text_casing(t(s, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "title"),
        """SELECT o_orderkey, array_to_string(list_transform(regexp_extract_all(o_orderpriority, '(\\pL+|\\PL+)'), lambda p: upper(p[1]) || lower(p[2:])), '') AS o_orderpriority FROM orders""".replace("\\\\", "\\")),
    "casing_sentence": (
        lambda s, d: M.change_case(t(s, d, "part").select("p_partkey", "p_name", "p_type"), ["p_name", "p_type"], "sentence"),
        "SELECT p_partkey, upper(p_name[1]) || lower(p_name[2:]) AS p_name, upper(p_type[1]) || lower(p_type[2:]) AS p_type FROM part"),
    "trim_whitespace": (
        lambda s, d: M.trim_whitespace(t(s, d, "documents").selectExpr("doc_id", "concat(' \t', text, ' \n') AS text")),
        r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '^[\s\x0B\pZ]+', ''), '[\s\x0B\pZ]+$', ''), '[\s\x0B\pZ]+', ' ', 'g') AS text FROM documents"),
    "trim_columns": (
        lambda s, d: M.trim_columns(t(s, d, "part").selectExpr("p_partkey", "concat('  ', replace(p_name, ' ', '   '), ' ') AS p_name")),
        "SELECT p_partkey, replace(p_name, ' ', '   ') AS p_name FROM part"),
    "standardize_values": (
        lambda s, d: M.standardize_values(t(s, d, "orders"), "o_orderpriority", {"1-urgent": "high", "2-HIGH": "high", "5-low": "low"}),
        """SELECT * REPLACE (CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high' WHEN '5-LOW' THEN 'low' ELSE o_orderpriority END AS o_orderpriority) FROM orders"""),
    "extract_date_part": (
        lambda s, d: D.extract_date_part(t(s, d, "events").select("event_id", "ts"), "ts", "dayofweek"), "SELECT event_id, ts, (isodow(ts) - 1)::INTEGER AS ts_dayofweek FROM events"),
    "extract_date_parts": (
        lambda s, d: D.extract_date_parts(t(s, d, "events").select("event_id", "ts"), ["ts"], ["year", "month", "day", "week", "quarter", "dayofyear", "hour", "minute", "second",
                                                                                              "weekday_name", "month_name", "daysinmonth", "is_weekend"]),
        """SELECT event_id, ts, year(ts)::INTEGER AS ts_year, month(ts)::INTEGER AS ts_month, day(ts)::INTEGER AS ts_day, week(ts)::INTEGER AS ts_week, quarter(ts)::INTEGER AS ts_quarter,
           dayofyear(ts)::INTEGER AS ts_dayofyear, hour(ts)::INTEGER AS ts_hour, minute(ts)::INTEGER AS ts_minute, second(ts)::INTEGER AS ts_second, dayname(ts) AS ts_weekday_name,
           monthname(ts) AS ts_month_name, day(last_day(ts))::INTEGER AS ts_daysinmonth, isodow(ts) >= 6 AS ts_is_weekend FROM events"""),
    "date_diff_days": (
        lambda s, d: D.date_diff(ordered_lines(s, d), "placed", "l_shipdate", "days", "days"), f"SELECT *, floor({SPAN} / 86400000000.0)::BIGINT AS days FROM {LINES}"),
    "date_diff_months": (
        lambda s, d: D.date_diff(ordered_lines(s, d), "placed", "l_shipdate", "months", "months", True).selectExpr("l_orderkey", "l_partkey", "l_linenumber", "months"),
        f"SELECT l_orderkey, l_partkey, l_linenumber, round_even(abs(floor({SPAN} / 86400000000.0) / 30.44::DOUBLE), 2) AS months FROM {LINES}"),
    "date_diff_hours": (
        lambda s, d: D.date_diff_columns(ordered_lines(s, d), ["placed", "l_shipdate"], unit="hours").selectExpr("l_orderkey", "l_partkey", "l_linenumber", "bround(date_diff, 4) AS date_diff"),
        f"SELECT l_orderkey, l_partkey, l_linenumber, round_even(abs({SPAN} / 3600000000.0::DOUBLE), 4) AS date_diff FROM {LINES}"),
    "date_add_months": (
        lambda s, d: D.date_add(t(s, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", 13, "months", "due"),
        "SELECT o_orderkey, o_orderdate, o_orderdate + INTERVAL 13 MONTH AS due FROM orders"),
    "date_add_hours": (
        lambda s, d: D.date_add(t(s, d, "events").select("event_id", "ts"), ["ts"], -36, "hours"), "SELECT event_id, ts - INTERVAL 36 HOUR AS ts FROM events"),
    "date_to_epoch": (
        lambda s, d: D.date_to_epoch(D.date_to_epoch(t(s, d, "events").select("event_id", "ts"), ["ts"], "milliseconds", "ms"), ["ts"], "nanoseconds", "ns"),
        "SELECT event_id, ts, epoch_us(ts) // 1000 AS ms, epoch_us(ts) * 1000 AS ns FROM events"),
    "parse_date": (
        lambda s, d: D.parse_date(t(s, d, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderstatus = 'F' THEN 'soon' ELSE date_format(o_orderdate, 'dd.MM.yyyy') END AS day"), ["day"], "%d.%m.%Y"),
        "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_orderdate END AS day FROM orders"),
}
