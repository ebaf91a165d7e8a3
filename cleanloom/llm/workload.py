"""The queries of the subpackage with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import cut, shared_folder, table
from .conversations import damaged, repaired
from .exact import exact_dedup
from .licences import scan_licences
from .mixing import mixed
from .neardup import classes
from .negatives import hard_negatives
from .neighbours import search
from .pieces import sampled
from .pii import BASE, fit, mark
from .quality import host_verdicts, judged, measured
from .secrets import scan_secrets
from .sharding import shard_rows
from .tokens import read_tokens, write_tokens


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer lies; the operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simple8b_tokens(spark: SparkSession, folder: str) -> DataFrame:
    to = shared_folder(spark)
    write_tokens(table(spark, folder, "documents"), to, tokenizer_file("word_bpe_49k.json"), end_id=1)
    return read_tokens(spark, to, digest=True)


def span_text(spans) -> Column:
    """kind:start:end of each span, joined by commas"""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def span_count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op2_secret_ownership(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    base = F.filter("spans", lambda x: x["kind"] != "random")
    return scan_secrets(docs, keep=[docs["doc_id"]]).select(
        "row.doc_id", *[span_count(k) for k in ("assign", "access", "hex")], F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda x: x["live"])).cast("long").alias("n_live"))


def op3_licence_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return scan_licences(docs, keep=[docs["doc_id"]]).select("row.doc_id", "n_paragraphs", "n_confirmed", "n_unknown", "families")


def op4_dart_minhash(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    _, named = classes(docs, keep=[docs["doc_id"], docs["text"]])
    return named.select(F.col("id").alias("doc_id"), "class_id", "class_size", "kept")


def op5_adaptive_scan(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return search(vectors, vectors["vec_id"] % 100 == 0)


def op6_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return mixed(docs, keep=[docs["doc_id"]]).select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def op7_sampled_pieces(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return sampled(docs, tokenizer_file("piece_bpe_32k.model"), keep=[docs["doc_id"]], digest=True).select("row.*", "sample", "n_pieces", "log_prob", "log_inclusion", "ids_crc32", "round_trip")


def op8_histogram_shards(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    crc = F.crc32(F.coalesce(F.col("row.text").cast("string"), F.lit("")).cast("binary"))
    return shard_rows(docs, keep=[docs["doc_id"], docs["text"]]).select(
        "row.doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_host_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    m = cut(measured(docs).withColumn("row", F.struct("row.doc_id")))  # counts only, so the texts are read once
    return judged(m, host_verdicts(m)).select("row.doc_id", "m.*", "base_failed", "kept", "host_failed", F.col("host").alias("source"))


def op10_weak_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = mark(docs, fit(docs), keep=[docs["doc_id"]])
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return found.select("row.doc_id", *[span_count(k) for k in BASE], F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def op11_extendible_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return exact_dedup(docs, keep=[docs["doc_id"]]).select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "embeddings")
    label = F.when(v["vec_id"] % 7 == 0, (v["label"] + 1) % 10).otherwise(v["label"])
    return hard_negatives(v, v["vec_id"] % 100 == 0, label)


def op13_repaired_talks(spark: SparkSession, folder: str) -> DataFrame:
    found = repaired(damaged(table(spark, folder, "conversations")), present=F.col("there"), turns=False)
    return found.select("conv_id", "summary.*")


Q = {f.__name__: f for f in (op1_simple8b_tokens, op2_secret_ownership, op3_licence_classifier, op4_dart_minhash, op5_adaptive_scan, op6_mix_sources, op7_sampled_pieces, op8_histogram_shards, op9_host_rules, op10_weak_pii,
                             op11_extendible_dedup, op12_hard_negatives, op13_repaired_talks)}
SQL = {
    "op9_host_rules": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w),
c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS n FROM p),
r AS (SELECT rid, count(DISTINCT j) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM c WHERE n > 1) GROUP BY 1),
m AS (SELECT doc_id, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r USING (rid)),
f AS (SELECT *, [n_words < 50, 100 * n_repeat_words > 50 * n_words, 10 * n_symbols > n_words, word_chars < 3 * n_words OR word_chars > 12 * n_words] AS failed FROM m),
h AS (SELECT source, k, count(*) AS n, sum(failed[k]::INT) AS bad FROM f, range(1, 5) g(k) WHERE source IS NOT NULL GROUP BY 1, 2),
a AS (SELECT k, count(*) AS hosts, sum(round(bad / n * 1e9)) / 1e9 / count(*) AS mean, sum(round(bad / n * (bad / n) * 1e9)) / 1e9 / count(*) AS squares, sum(round(1 / n * 1e9)) / 1e9 / count(*) AS chance FROM h GROUP BY 1),
v AS (SELECT k, mean, squares - mean * mean - mean * (1 - mean) * chance AS spread FROM a),
z AS (SELECT k, mean, CASE WHEN spread <= 1e-9 THEN 1000.0 ELSE least(1000.0, greatest(2.0, mean * (1 - mean) / spread - 1)) END AS weight FROM v),
x AS (SELECT source, bool_or((bad + weight * mean) / (n + weight) > 0.5) AS host_failed FROM h JOIN z USING (k) GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed[1] OR failed[2] AS base_failed, NOT (failed[1] OR failed[2]) AND NOT coalesce(host_failed, false) AS kept,
  coalesce(host_failed, false) AS host_failed, f.source FROM f LEFT JOIN x ON f.source = x.source""",
    "op2_secret_ownership": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, chr(1)) AS owner, coalesce(source, chr(1)) || chr(2) || coalesce(lang, chr(1)) AS repo, coalesce(text, '') AS t FROM documents),
k AS (SELECT * FROM (VALUES (0, 'assign', '(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+', '(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
       (1, 'access', 'AKIA[A-Z0-9]+', '(AKIA[A-Z0-9]+)'), (2, 'hex', '[0-9a-f]{24,}', '([0-9a-f]{24,})'), (3, 'random', '[A-Za-z0-9_-]{20,}', '([A-Za-z0-9_-]{20,})')) v(ord, kind, p, g)),
m AS (SELECT rid, doc_id, owner, repo, ord, kind, string_split_regex(t, p) AS pieces, regexp_extract_all(t, p) AS found, regexp_extract_all(t, g, 1) AS vals FROM d, k WHERE regexp_matches(t, p)),
e AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM m),
c AS (SELECT rid, owner, repo, ord, kind, vals[i] AS val, (list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0))::BIGINT AS a, length(found[i]) AS n FROM e),
o AS (SELECT *, a + n AS z FROM c WHERE (kind <> 'assign' OR length(val) >= 6) AND (kind <> 'access' OR n >= 20)
        AND (kind <> 'random' OR regexp_matches(val, '[0-9]') AND regexp_matches(val, '[a-z]') AND regexp_matches(val, '[A-Z]') AND len(list_distinct(string_split(val, ''))) >= 12)),
w AS (SELECT val, count(DISTINCT owner) AS owners, count(DISTINCT repo) AS repos FROM o GROUP BY 1),
s AS (SELECT o.*, owners < 2 AND repos < 3 AS live FROM o JOIN w USING (val)),
b AS (SELECT * FROM s WHERE kind <> 'random' UNION ALL SELECT * FROM s WHERE kind = 'random' AND live AND NOT EXISTS (SELECT 1 FROM s q WHERE q.rid = s.rid AND q.kind <> 'random' AND q.a < s.z AND q.z > s.a)),
j AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (live) AS n_live,
        string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, ord) FILTER (kind <> 'random') AS base, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, ord) AS spans FROM b GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0)::BIGINT AS n_live FROM d LEFT JOIN j USING (rid)""",
    "op11_extendible_dedup": r"""
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY k) AS group_size, row_number() OVER w = 1 AS kept, sha256(k) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS k FROM documents)
WINDOW w AS (PARTITION BY k ORDER BY length(t) DESC, doc_id)""",
    "op12_hard_negatives": r"""
WITH e AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
g AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM p WHERE label = anchor_label QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM g JOIN p USING (anchor_id)
WHERE label <> anchor_label AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10""",
    # cost to go by recursion from the last row, then the first letter that keeps it: letters name their edits here
    "op13_repaired_talks": r"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
h AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 20 AS what FROM k),
f AS (SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role, CASE what WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN what = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE what <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said FROM f),
q AS (SELECT *, CASE WHEN said = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'k' END AS fault, left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
c AS (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, conv_id FROM (SELECT DISTINCT conv_id FROM conversations)),
r AS (SELECT c, q.* FROM q JOIN c ON q.conv_id IS NOT DISTINCT FROM c.conv_id),
s AS (SELECT c, count(r.i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
        count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM c LEFT JOIN r USING (c) GROUP BY c),
t AS (SELECT c, n AS i, [0, 4, 2, 0] AS v FROM s
  UNION ALL
  SELECT c, i, [least(w[1], 2 + u), least(w[2], 2 + u), u, least(w[4], 2 + u)] FROM (SELECT *, least(w[3], 2 + w[4]) AS u FROM (
    SELECT t.c, t.i - 1 AS i, CASE WHEN fault IN ('b', 'd') THEN [3 + v[1], 3 + v[2], 3 + v[3], 3 + v[4]] ELSE
      [least(3 + v[1], g + CASE WHEN ini = 'u' THEN 0 ELSE 2 END + v[3], CASE WHEN ini = 's' THEN g + v[2] ELSE 3 + v[1] END), least(3 + v[2], g + CASE WHEN ini = 'u' THEN 0 ELSE 2 END + v[3]),
       least(3 + v[3], g + CASE WHEN ini = 'a' THEN 0 ELSE 2 END + v[4]), least(3 + v[4], g + CASE WHEN ini = 'u' THEN 0 ELSE 2 END + v[3])] END AS w
    FROM t JOIN (SELECT *, CASE WHEN fault = 't' THEN 1 ELSE 0 END AS g FROM r) r ON r.c = t.c AND r.i = t.i) x) y),
z AS (SELECT s.c, 0::BIGINT AS i, 1 AS st, '' AS audit, []::VARCHAR[] AS said, n, 0::BIGINT AS steps FROM s
  UNION ALL
  SELECT c, CASE e WHEN 'I' THEN i ELSE i + 1 END, CASE WHEN e = 'D' THEN st WHEN e = 'K' AND ini = 's' THEN 2 WHEN st = 3 THEN 4 ELSE 3 END, audit || e,
    CASE WHEN e = 'D' THEN said WHEN e = 'K' THEN list_append(said, role || ':' || text) ELSE list_append(said, CASE WHEN st = 3 THEN 'assistant:' ELSE 'user:' END || CASE WHEN e = 'R' THEN text ELSE '' END) END, n, steps + 1
  FROM (SELECT z.*, r.role, r.text, r.ini, CASE WHEN z.i < z.n AND a.v[st] = 3 + b.v[st] THEN 'D' WHEN a.v[st] = 2 + a.v[CASE WHEN st = 3 THEN 4 ELSE 3 END] THEN 'I'
          WHEN r.fault IN ('k', 't') AND a.v[st] = CASE WHEN fault = 't' THEN 1 ELSE 0 END + b.v[CASE WHEN ini = 's' THEN 2 WHEN st = 3 THEN 4 ELSE 3 END]
            AND (ini = 's' AND st = 1 OR ini = 'u' AND st <> 3 OR ini = 'a' AND st = 3) THEN 'K' ELSE 'R' END AS e
        FROM z JOIN t a ON a.c = z.c AND a.i = z.i LEFT JOIN t b ON b.c = z.c AND b.i = z.i + 1 LEFT JOIN r ON r.c = z.c AND r.i = z.i + 1
        WHERE z.i < z.n OR st IN (2, 3)) x)
SELECT conv_id, gaps::BIGINT AS gaps, blank, duplicate, truncated, illegal, v[1]::BIGINT AS cost, audit, sha256(array_to_string(said, chr(10))) AS repaired_sha256
FROM c JOIN s USING (c) JOIN t ON t.c = c.c AND t.i = 0 JOIN (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY c ORDER BY steps DESC) = 1) z ON z.c = c.c""",
}


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict:
    return dict(SQL)
