"""Queries of the corpus operators, each over its whole table, with DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.shared import spread

from . import chat, decontam, langid, lattice, mixing, pagetext, quality, sharding, simhash, urlfilter
from .common import work_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages"))


def op3_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = r"\### Assistant: </turn> ok"
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], turns.schema)
    return chat.digests(turns.unionByName(more))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), work_dir(spark, "shards"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagetext.extract(_table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_url_filter": op2_url_filter,
    "op3_lattice": op3_lattice,
    "op4_decontamination": op4_decontamination,
    "op5_chat": op5_chat,
    "op6_sharding": op6_sharding,
    "op7_quality": op7_quality,
    "op8_language": op8_language,
    "op9_simhash": op9_simhash,
    "op10_page_text": op10_page_text,
}

_OP2_SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(rule, rule_host, rule_path, verdict) AS (
  VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'), ('net/de/', 'net', '/de/', 'allow'),
         ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')
), links AS (
  SELECT regexp_replace(url, '(?s)#.*$', '') AS a, regexp_replace(target, '(?s)#.*$', '') AS b FROM (
    SELECT url, unnest(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*"?canonical"?[^>]*\bhref\s*=\s*"([^"]*)"', 1)) AS target FROM p WHERE url LIKE '%://%'
  ) WHERE target LIKE '%://%'
), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
urls AS (
  SELECT DISTINCT u, coalesce(translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM (SELECT a AS u FROM both_ways UNION SELECT b FROM both_ways)
), said AS (
  SELECT u, (SELECT arg_max(verdict, length(rule)) FROM rules WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS v FROM urls
), carried AS (
  SELECT r.a AS u FROM reach r JOIN said s ON s.u = r.b GROUP BY r.a HAVING bool_or(coalesce(s.v, '') = 'block') AND NOT bool_or(coalesce(s.v, '') = 'allow')
), own AS (
  SELECT page_id, url, host, path,
    (SELECT arg_max(rule, length(rule)) FROM rules WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS rule,
    (SELECT arg_max(verdict, length(rule)) FROM rules WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS verdict
  FROM p
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN regexp_replace(url, '(?s)#.*$', '') IN (SELECT u FROM carried) THEN 'block' END, 'allow') AS verdict
FROM own
"""

_OP5_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), e AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS text_out,
    replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:') AS role_out
  FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('### ' || role_out || ': ' || text_out || ' </turn>' || chr(10)))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

_OP4_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, p, p + least(len(w), 10) - 1), ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM i WHERE len(w) > 0)
), hit AS (
  SELECT row_no, p, x.n, item_id FROM (
    SELECT row_no, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS k
    FROM (SELECT row_no, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
  ) x JOIN win ON x.k = win.k AND x.n = win.n
), words AS (
  SELECT row_no, count(DISTINCT q) AS n_hit FROM (SELECT row_no, unnest(range(p, p + n)) AS q FROM hit) GROUP BY row_no
), items AS (
  SELECT row_no, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS listed FROM (SELECT DISTINCT row_no, item_id::VARCHAR AS s FROM hit WHERE item_id IS NOT NULL) GROUP BY row_no
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (row_no) LEFT JOIN items USING (row_no)
"""

_OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_no, doc_id, source AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), raw AS (SELECT row_no, host, line, pos FROM (SELECT row_no, host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d)),
lines AS (
  SELECT row_no, host, pos, line, len(lw) AS words, translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS normal
  FROM (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw FROM raw) WHERE len(lw) > 0
), dup AS (SELECT row_no, sum(n - 1)::BIGINT AS n FROM (SELECT row_no, line, count(*) AS n FROM lines GROUP BY ALL) GROUP BY row_no),
doc AS (SELECT row_no, host, coalesce(string_agg(normal, chr(10) ORDER BY pos), '') AS whole FROM d LEFT JOIN lines USING (row_no, host) GROUP BY row_no, host),
hosts AS (SELECT host, count(DISTINCT whole) AS docs FROM (SELECT d.row_no, d.host, coalesce(whole, '') AS whole FROM d LEFT JOIN doc USING (row_no)) GROUP BY host),
held AS (SELECT l.host, l.normal, count(DISTINCT whole) AS n FROM lines l JOIN doc USING (row_no) GROUP BY l.host, l.normal),
bad AS (SELECT held.host, normal FROM held JOIN hosts ON held.host IS NOT DISTINCT FROM hosts.host WHERE n > greatest(10.0::DOUBLE, docs * 0.005::DOUBLE)),
gone AS (SELECT row_no, sum(words)::BIGINT AS n FROM lines l JOIN bad ON l.normal = bad.normal AND l.host IS NOT DISTINCT FROM bad.host GROUP BY row_no),
win AS (SELECT row_no, p, [w[p], w[p + 1], w[p + 2]] AS k FROM (SELECT row_no, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) > 3)),
twice AS (SELECT row_no, p FROM (SELECT row_no, p, count(*) OVER (PARTITION BY row_no, k) AS n FROM win) WHERE n > 1),
rep AS (SELECT row_no, count(DISTINCT q)::BIGINT AS n FROM (SELECT row_no, unnest([p, p + 1, p + 2]) AS q FROM twice) GROUP BY row_no),
counted AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS n_removed_words
  FROM d LEFT JOIN dup USING (row_no) LEFT JOIN rep USING (row_no) LEFT JOIN gone USING (row_no)
)
SELECT *, base_failed = false AND n_words - n_removed_words >= 0.3::DOUBLE * n_words AS kept
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
"""

ORACLE_SQL: dict[str, str] = {"op2_url_filter": _OP2_SQL, "op4_decontamination": _OP4_SQL, "op5_chat": _OP5_SQL, "op7_quality": _OP7_SQL}
