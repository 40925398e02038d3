"""Queries of the training-data operators over the driver's tables, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logtide.llm import decontaminate, gru_lm, license_scan, ngram_join, quality_rules, secret_scan, sentencepiece_codec, token_counts, url_filter, warc
from logtide.llm.common import load


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(load(spark, sf_dir, "documents"))


def op2_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(load(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(load(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.history(load(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(load(spark, sf_dir, "pages"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op7_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_lm.score(load(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(load(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(load(spark, sf_dir, "pages"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(load(spark, sf_dir, "documents"), gram=3, percent=90)


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_sentencepiece_codec": op2_sentencepiece_codec,
    "op3_secret_scan": op3_secret_scan,
    "op4_token_counts": op4_token_counts,
    "op5_warc": op5_warc,
    "op6_decontaminate": op6_decontaminate,
    "op7_gru_lm": op7_gru_lm,
    "op8_license_scan": op8_license_scan,
    "op9_url_filter": op9_url_filter,
    "op10_ngram_join": op10_ngram_join,
}

_OP9_SQL = r"""
WITH u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r(verdict, rule_host, rule_path) AS (VALUES
  ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fits AS (
  SELECT DISTINCT u.host, u.path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM u) u JOIN r
    ON (u.host = r.rule_host OR ends_with(u.host, '.' || r.rule_host)) AND starts_with(u.path, r.rule_path)
  GROUP BY u.host, u.path)
SELECT u.page_id, u.host, u.path, f.rule,
       coalesce(f.verdict, CASE WHEN u.host = 'casino-win.example.net' OR ends_with(u.host, '.casino-win.example.net') THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN fits f USING (host, path)
"""

_OP3_KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 0),
    ("hex", r"[0-9a-f]{16,}", 0, 0),
    ("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
)


def _op3_sql() -> str:
    """Spans from the lengths of matches and of the gaps between them."""
    parts = []
    for order, (kind, pattern, group, least) in enumerate(_OP3_KINDS):
        p = pattern.replace("'", "''")
        parts.append(f"""
  SELECT row_id, {order} AS kind, '{kind}' AS name, unnest(range(1, len(m) + 1)) AS k, m, c, g, {least} AS least
  FROM (SELECT row_id, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {group}) AS c, string_split_regex(t, '{p}') AS g FROM d)""")
    union = " UNION ALL ".join(parts)
    return f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t FROM documents),
hits AS ({union}),
spans AS (
  SELECT row_id, kind, name, length(c[k]) >= least AS ok,
         sum(length(g[k]) + length(m[k])) OVER (PARTITION BY row_id, kind ORDER BY k) AS e, length(m[k]) AS n
  FROM hits),
found AS (
  SELECT row_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg(name || ':' || (e - n) || ':' || e, ',' ORDER BY e - n, kind) FILTER (kind < 3) AS base,
         string_agg(name || ':' || (e - n) || ':' || e, ',' ORDER BY e - n, kind) AS spans
  FROM spans WHERE ok GROUP BY row_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN found USING (row_id)
"""


_OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND top IS NOT NULL AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM m
"""

ORACLE_SQL: dict[str, str] = {
    "op5_warc": _OP5_SQL,
    "op3_secret_scan": _op3_sql(),
    "op9_url_filter": _OP9_SQL,
}
