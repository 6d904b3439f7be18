"""Named queries over the driver's tables and the DuckDB SQL that must agree with them.

Each query runs an operator of the engine over its whole table and whole texts. Rules of the
normalizer that the tables hardly meet are run on texts with noise added at their end: the
queries named after the rules, and normalize_noise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BATCH_SIZES, BUCKETS, EmbedConfig, autoscale
from ..functions import normalize as norm
from ..functions import vectors
from ..operators import batching, dedup, metrics, tokenize, vocab
from ..operators.encoders import hash_vectors
from ..operators.models import REGISTRY
from ..shared import hadoop_path, spread, store, work_dir
from ..sources import sinks, text
from .engine import Engine

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


# --- the normalizer ------------------------------------------------------------------------

NOISE = (
    " see [Docs](http://h.example/x) and https://Some.example/a?b=1] now",
    " mail a.b@c.example.org or d@e.example today",
    " sum d41d8cd98f00b204e9800998ecf8427e at 0xBEEF12 done",
    " in /usr/local/lib/x.so and /single for v1.2.3 or 10.20.30.40 but 1.2 stays",
    " fix #42 by u/bob in /r/rust and you/me reader/writer",
    " id 1234567 not 12345 xx654321 wow!!!! really??? hmm.... a,,,,b c::::d e;;;f",
)


def _noisy(x: Column, key: Column) -> Column:
    return F.concat(x, F.element_at(F.array(*[F.lit(n) for n in NOISE]), (key % len(NOISE) + 1).cast("int")))


_S, _NS = r"[\s\x{0B}\x{85}\p{Z}]", r"[^\s\x{0B}\x{85}\p{Z}]"
#: The same patterns for RE2, whose word boundary is ASCII's and whose other classes must be spelled
#: out, as (pattern, replacement); NS stands for characters that are no white space.
_SQL_PATTERNS = {
    "strip_markdown": (r"\[([^\]]*)\]\([^)]*\)", r"\1"),
    "strip_urls": (r"(?i)\[?https?://NS+\]?", ""),
    "strip_emails": (r"NS+@NS+\.NS+", ""),
    "strip_hashes": (r"\b[0-9a-fA-F]{32,}\b", ""),
    "strip_hex": (r"0x[0-9a-fA-F]+", ""),
    "strip_paths": (r"(/[\p{L}\p{M}\p{Nd}\p{Pc}.\-]+){2,}", ""),
    "strip_versions": (r"\bv?\p{Nd}+\.\p{Nd}+(\.\p{Nd}+)+\b", ""),
    "strip_issues": (r"#\p{Nd}+", ""),
    "strip_users": (r"/?u/NS+", ""),
    "strip_boards": (r"/?r/NS+", ""),
    "strip_numbers": (r"\b\p{Nd}{6,}\b", ""),
    "collapse_punct": None,
    "collapse_ws": (_S + "+", " "),
    "trim_lower": None,
    "alpha_words": None,
}


def _sql_step(name: str, x: str) -> str:
    if name == "collapse_punct":
        for mark in "!?.,:;":
            x = f"regexp_replace({x}, '[{mark}]{{3,}}', '{mark}{mark}', 'g')"
        return x
    if name == "trim_lower":
        return f"lower(trim({x}, ' '))"
    if name == "alpha_words":
        return f"array_to_string(list_filter(string_split({x}, ' '), lambda w: regexp_matches(w, '[\\p{{L}}\\p{{Nl}}]')), ' ')"
    pattern, to = _SQL_PATTERNS[name]
    return f"regexp_replace({x}, '{pattern.replace('NS', _NS)}', '{to}', 'g')"


def _sql_cut(x: str, most: int) -> str:
    """The longest start within ``most`` bytes: as many characters as do not pass it."""
    return f"left({x}, (SELECT coalesce(max(k), 0) FROM range(0, {most} + 1) t(k) WHERE strlen(left({x}, k::BIGINT)) <= {most}))"


_SQL_NOISE = "text || ([" + ", ".join("'" + n + "'" for n in NOISE) + f"])[doc_id % {len(NOISE)} + 1]"


def _chain_sql(x: str) -> str:
    for name in _SQL_PATTERNS:
        x = _sql_step(name, x)
    return x


def _normalized_sql(source: str, key: str, x: str, *, most: int = 256, least: int = 10, prefix: str = "passage: ") -> str:
    return f"""
      SELECT {key}, CASE WHEN strlen(c) >= {least} THEN '{prefix}' || c END AS norm_text
      FROM (SELECT {key}, {_sql_cut("z", most)} AS c FROM (SELECT {key}, {_chain_sql(x)} AS z FROM {source}))
    """


def _add_step(name: str) -> None:
    def query(spark: SparkSession, sf_dir: str, name=name) -> DataFrame:
        docs = _table(spark, sf_dir, "documents")
        x = _noisy(F.col("text"), F.col("doc_id"))
        own = {"trim_lower": norm.trim_lower, "alpha_words": lambda c: norm.alpha_words(F.regexp_replace(c, r"(?U)\s+", " "))}
        return docs.select("doc_id", (own[name] if name in own else norm.pattern_step(name))(x).alias("out"))

    QUERIES[name] = query
    x = f"({_SQL_NOISE})"
    x = _sql_step("collapse_ws", x) if name == "alpha_words" else x
    ORACLE_SQL[name] = f"SELECT doc_id, {_sql_step(name, x)} AS out FROM documents"


for _name in _SQL_PATTERNS:
    _add_step(_name)


@_query(f"SELECT doc_id, {_sql_cut('text', 100)} AS out FROM documents")
def truncate_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", norm.truncate_bytes(F.col("text"), 100).alias("out"))


@_query("SELECT count(*) AS n, count(*) FILTER (strlen(text) < 300) AS rejected FROM documents")
def min_bytes_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = norm.reject_short(F.col("text"), 300)
    return _table(spark, sf_dir, "documents").agg(F.count("*").alias("n"), F.count_if(kept.isNull()).alias("rejected"))


def _normal(df: DataFrame, key: list[str], x: Column) -> DataFrame:
    return df.select(*key, norm.normalize(x).alias("norm_text"))


@_query(_normalized_sql("documents", "doc_id", "text"))
def normalize_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normal(_table(spark, sf_dir, "documents"), ["doc_id"], F.col("text"))


@_query(f"SELECT doc_id, CASE WHEN strlen(z) >= 10 THEN 'passage: ' || z END AS norm_text FROM (SELECT doc_id, {_chain_sql(f'({_SQL_NOISE})')} AS z FROM documents)")
def normalize_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in, and whole texts out: nothing is cut to a number of bytes."""
    x = _noisy(F.col("text"), F.col("doc_id"))
    return _table(spark, sf_dir, "documents").select("doc_id", norm.normalize(x, max_bytes=0).alias("norm_text"))


@_query(_normalized_sql("conversations", "conv_id, turn", "text"))
def normalize_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normal(_table(spark, sf_dir, "conversations"), ["conv_id", "turn"], F.col("text"))


@_query(_normalized_sql("benchmark", "item_id", "text"))
def normalize_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normal(_table(spark, sf_dir, "benchmark"), ["item_id"], F.col("text"))


@_query(_normalized_sql("pages", "page_id", "'see ' || url || ' for more'"))
def normalize_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normal(_table(spark, sf_dir, "pages"), ["page_id"], F.concat(F.lit("see "), "url", F.lit(" for more")))


# --- sources -------------------------------------------------------------------------------


@_query("SELECT doc_id FROM documents WHERE strlen(text) >= 10")
def short_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").where(F.octet_length("text") >= EmbedConfig().min_input_bytes).select("doc_id")


@_query("SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS seq FROM conversations WHERE strlen(text) >= 10")
def dense_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").where(F.octet_length("text") >= 10).select("conv_id", "turn")
    return text.dense_seq(rows, "conv_id", "turn")


@_query("SELECT doc_id, pos, trim(line, ' ') AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents) WHERE trim(line, ' ') <> ''")
def plain_scan_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "value"))
    return text.parse_plain(lines).select("doc_id", F.col("pos").cast("long").alias("pos"), "text")


_JSON_LINES = """
  SELECT event_id, CASE event_id % 6
    WHEN 0 THEN '{"id":"e' || event_id || '","text":" ' || event_type || ' ' || user_id || ' "}'
    WHEN 1 THEN '{"id":' || event_id || ',"text":"' || event_type || '"}'
    WHEN 2 THEN '{"text":' || user_id || '}'
    WHEN 3 THEN '{"text":"   "}'
    WHEN 4 THEN props
    ELSE 'no json ' || event_id END AS value
  FROM events
"""


@_query(
    f"""
    SELECT event_id, CASE WHEN json_type(j, '$.id') = 'VARCHAR' THEN json_extract_string(j, '$.id') ELSE '' END AS id,
      nullif(CASE WHEN json_type(j, '$.text') = 'VARCHAR' THEN trim(json_extract_string(j, '$.text'), ' ') END, '') AS text,
      coalesce(nullif(CASE WHEN json_type(j, '$.text') = 'VARCHAR' THEN trim(json_extract_string(j, '$.text'), ' ') END, '') IS NOT NULL, false) AS ok
    FROM (SELECT event_id, CASE WHEN json_valid(value) THEN value::JSON END AS j FROM ({_JSON_LINES}))
    """
)
def jsonl_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.parse_jsonl(_json_lines(spark, sf_dir)).select("event_id", "id", "text", "ok")


def _json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    k = F.col("event_id") % 6
    value = (
        F.when(k == 0, F.concat(F.lit('{"id":"e'), "event_id", F.lit('","text":" '), "event_type", F.lit(" "), "user_id", F.lit(' "}')))
        .when(k == 1, F.concat(F.lit('{"id":'), "event_id", F.lit(',"text":"'), "event_type", F.lit('"}')))
        .when(k == 2, F.concat(F.lit('{"text":'), "user_id", F.lit("}")))
        .when(k == 3, F.lit('{"text":"   "}'))
        .when(k == 4, F.col("props"))
        .otherwise(F.concat(F.lit("no json "), "event_id"))
    )
    return e.select("event_id", value.alias("value"))


@_query(
    f"""
    SELECT count(*) AS lines, count(*) FILTER (t IS NULL) AS malformed, count(*) FILTER (strlen(t) < 9) AS short, count(*) FILTER (strlen(t) >= 9) AS accepted
    FROM (SELECT nullif(CASE WHEN json_type(j, '$.text') = 'VARCHAR' THEN trim(json_extract_string(j, '$.text'), ' ') END, '') AS t
      FROM (SELECT CASE WHEN json_valid(value) THEN value::JSON END AS j FROM ({_JSON_LINES})))
    """
)
def input_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good lines, short ones, other JSON, no JSON, and (a part of the last) bytes that are no UTF-8."""
    lines = _json_lines(spark, sf_dir)
    broken = F.concat(F.encode(F.lit('{"text":"some words '), "UTF-8"), F.unhex(F.lit("FFFE")), F.encode(F.lit('"}'), "UTF-8")).cast("string")
    lines = lines.withColumn("value", F.when(F.col("event_id") % 12 == 11, broken).otherwise(F.col("value")))
    return text.input_stats(text.parse_jsonl(lines), 9)


@_query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 137")
def row_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.first_of(_table(spark, sf_dir, "documents").select("doc_id"), 137, "doc_id")  # the feature is the limit


@_query("SELECT page_id, CASE WHEN url <> '' THEN url || '. ' || html ELSE html END AS text FROM pages")
def title_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", text.with_title(F.col("url"), F.col("html")).alias("text"))


_LINES_SQL = "SELECT unnest(string_split(text, chr(10))) AS line FROM documents"


@_query(f"SELECT 'passage: ' || t AS text FROM (SELECT trim(line, ' ') AS t FROM ({_LINES_SQL})) WHERE length(t) BETWEEN 50 AND 256")
def passage_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return text.passages(lines, "line")


@_query(f"SELECT t AS text FROM (SELECT trim(line, ' ') AS t FROM ({_LINES_SQL})) WHERE length(t) >= 10")
def post_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return text.posts(lines, "line")


@_query("SELECT count(*) AS n FROM documents WHERE text <> ''")
def jsonl_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as gzip JSONL, found again, strictly validated and counted."""
    folder = work_dir(spark, "jsonl")
    _table(spark, sf_dir, "documents").where("text <> ''").select(F.col("doc_id").cast("string").alias("id"), "text").write.option("compression", "gzip").json(folder)
    n = text.validate_jsonl(text.read_lines(spark, [folder]))
    return spark.createDataFrame([(n,)], "n long")


# --- dedup, vocabulary, tokens -------------------------------------------------------------

_NORM_DOCS_SQL = _normalized_sql("documents", "doc_id", "text")


def _norm_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm.surviving(_table(spark, sf_dir, "documents"), F.col("text"), "doc_id")


@_query(f"SELECT norm_text, count(*) AS n FROM ({_NORM_DOCS_SQL}) WHERE norm_text IS NOT NULL GROUP BY norm_text")
def dedup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.distinct_texts(_norm_docs(spark, sf_dir), "norm_text", nulls=False)


@_query(f"SELECT count(norm_text) AS rows, count(DISTINCT norm_text) AS dedup_size, count(norm_text) - count(DISTINCT norm_text) AS dedup_hits FROM ({_NORM_DOCS_SQL})")
def dedup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.stats(_norm_docs(spark, sf_dir), "norm_text", nulls=False)


_VOCAB_SQL = r"""
  SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '\s+')) AS word FROM documents)
  WHERE word <> '' AND length(word) <= 45 AND regexp_matches(word, '[\p{L}\p{Nl}]') GROUP BY word ORDER BY n DESC, word LIMIT 1500000
"""


@_query(f"SELECT * FROM ({_VOCAB_SQL}) ORDER BY n DESC, word LIMIT 500")
def word_counts_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.top_words(_table(spark, sf_dir, "documents"), most=500)  # a top-k report


_WORDS_SQL = f"SELECT doc_id, unnest(string_split(norm_text, ' ')) AS word FROM ({_NORM_DOCS_SQL}) WHERE norm_text IS NOT NULL"


@_query(f"SELECT count(*) AS words, count(v.word) AS hits, round(count(v.word) / count(*), 6) AS hit_rate FROM ({_WORDS_SQL}) w LEFT JOIN ({_VOCAB_SQL}) v USING (word) WHERE w.word <> ''")
def vocab_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = vocab.top_words(_table(spark, sf_dir, "documents"))
    return tokenize.hit_rate(_norm_docs(spark, sf_dir), words, "norm_text").withColumn("hit_rate", F.round("hit_rate", 6))


_TOKENS_SQL = f"""
  SELECT doc_id, [0] || list_slice(flatten(list(p ORDER BY pos)), 1, 254) || [2] AS ids FROM (
    SELECT doc_id, pos, CASE WHEN v.word IS NULL THEN [3::BIGINT] ELSE [('0x' || substr(md5(w.word), 1, 4))::BIGINT, ('0x' || substr(md5(w.word), 5, 4))::BIGINT] END AS p FROM (
      SELECT doc_id, unnest(string_split(norm_text, ' ')) AS word, generate_subscripts(string_split(norm_text, ' '), 1) AS pos
      FROM ({_NORM_DOCS_SQL}) WHERE norm_text IS NOT NULL) w LEFT JOIN ({_VOCAB_SQL}) v ON w.word = v.word WHERE w.word <> '')
  GROUP BY doc_id
"""


def _half(word: Column, start: int) -> Column:
    return F.conv(F.substring(F.md5(word.cast("binary")), start, 4), 16, 10).cast("int")


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = vocab.top_words(_table(spark, sf_dir, "documents")).select("word", F.array(_half(F.col("word"), 1), _half(F.col("word"), 5)).alias("ids"))
    return tokenize.token_ids(_norm_docs(spark, sf_dir), store(known, "vocabulary"), key="doc_id", column="norm_text")


@_query(f"SELECT doc_id, array_to_string(ids, ' ') AS ids FROM ({_TOKENS_SQL})")
def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir).select("doc_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


# --- buckets and batches -------------------------------------------------------------------

_LEN_SQL = f"SELECT doc_id, len(string_split(norm_text, ' ')) + 2 AS n FROM ({_NORM_DOCS_SQL}) WHERE norm_text IS NOT NULL"
_SMALL = (24, 32, 40, 48, 56)
_SMALL_SIZES = (64, 48, 32, 16, 8)


def _sql_bucket(n: str, buckets) -> str:
    return "CASE " + " ".join(f"WHEN {n} <= {b} THEN {i}" for i, b in enumerate(buckets[:-1])) + f" ELSE {len(buckets) - 1} END"


def _sql_of(bucket: str, values) -> str:
    return f"([{', '.join(map(str, values))}])[{bucket} + 1]"


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _norm_docs(spark, sf_dir).select("doc_id", (F.size(F.split("norm_text", " ")) + 2).alias("n"))


@_query(f"SELECT doc_id, {_sql_bucket('n', BUCKETS)} AS bucket FROM ({_LEN_SQL})")
def bucket_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lengths(spark, sf_dir).select("doc_id", vectors.bucket_of(F.col("n"), BUCKETS).alias("bucket"))


@_query(f"SELECT {_sql_bucket('n', BUCKETS)} AS bucket, count(*) AS messages FROM ({_LEN_SQL}) GROUP BY 1")
def bucket_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lengths(spark, sf_dir).groupBy(vectors.bucket_of(F.col("n"), BUCKETS).alias("bucket")).agg(F.count("*").alias("messages"))


_BATCHED_SQL = f"""
  SELECT doc_id, bucket, n, floor(nr / {_sql_of("bucket", _SMALL_SIZES)})::BIGINT AS batch, nr % {_sql_of("bucket", _SMALL_SIZES)} AS place
  FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY doc_id) - 1 AS nr FROM (SELECT doc_id, n, {_sql_bucket("n", _SMALL)} AS bucket FROM ({_LEN_SQL})))
"""


def _batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.with_batches(store(_lengths(spark, sf_dir), "lengths"), "n", "doc_id", _SMALL, _SMALL_SIZES)


@_query(f"SELECT doc_id, bucket, batch, place FROM ({_BATCHED_SQL})")
def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batched(spark, sf_dir).select("doc_id", "bucket", "batch", "place")


@_query(
    f"""SELECT count(*) AS batches, sum(n_real)::BIGINT AS n_real, sum(batch_size)::BIGINT AS capacity, round(sum(n_real) / sum(batch_size), 6) AS fill_ratio
    FROM (SELECT bucket, batch, count(*) AS n_real, {_sql_of("any_value(bucket)", _SMALL_SIZES)} AS batch_size FROM ({_BATCHED_SQL}) GROUP BY bucket, batch)"""
)
def batch_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.fill(batching.batch_table(_batched(spark, sf_dir), _SMALL_SIZES)).withColumn("fill_ratio", F.round("fill_ratio", 6))


@_query(f"SELECT bucket, sum(least(n, len) )::BIGINT AS tokens, sum(len)::BIGINT AS capacity FROM (SELECT bucket, n, {_sql_of('bucket', _SMALL)} AS len FROM ({_BATCHED_SQL})) GROUP BY bucket")
def padding_waste(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lengths(spark, sf_dir).withColumn("bucket", vectors.bucket_of(F.col("n"), _SMALL))
    size = vectors.by_bucket(F.col("bucket"), _SMALL)
    return rows.groupBy("bucket").agg(F.sum(F.least("n", size)).alias("tokens"), F.sum(size).alias("capacity"))


@_query(
    f"""SELECT doc_id, array_to_string(list_slice(ids, 1, len) || list_transform(range(greatest(len - length(ids), 0)), lambda k: 0), ' ') AS padded,
      array_to_string(list_transform(range(len), lambda k: CASE WHEN k < length(ids) THEN 1 ELSE 0 END), ' ') AS mask
    FROM (SELECT doc_id, ids, {_sql_of(_sql_bucket("length(ids)", BUCKETS), BUCKETS)} AS len FROM ({_TOKENS_SQL}))"""
)
def pad_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = batching.padded(_tokens(spark, sf_dir), "ids", BUCKETS)
    return rows.select("doc_id", *[F.array_join(F.col(c).cast("array<string>"), " ").alias(c) for c in ("padded", "mask")])


@_query(f"SELECT d::BIGINT AS dim, b::BIGINT AS batch_size, (CASE WHEN d <= 768 THEN b ELSE greatest(64, ceil(b * 768 / d)) END)::BIGINT AS scaled FROM (VALUES (384), (768), (1024)) x(d), (VALUES {', '.join(f'({b})' for b in sorted(set(BATCH_SIZES)))}) y(b)")
def batch_autoscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(d, b, autoscale(b, d)) for d in (384, 768, 1024) for b in sorted(set(BATCH_SIZES))]
    return spark.createDataFrame(rows, "dim long, batch_size long, scaled long")


@_query(
    """SELECT 'intfloat/' || family || '-' || size || version AS name, dim FROM
      (VALUES ('multilingual-e5', ''), ('e5', '-v2')) f(family, version), (VALUES ('small', 384::BIGINT), ('base', 768), ('large', 1024)) s(size, dim)"""
)
def model_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(REGISTRY.items()), "name string, dim long")


# --- vectors and the whole engine ----------------------------------------------------------


@_query("SELECT vec_id, i, round(x / sqrt(greatest(s, 1e-12)), 4) + 0.0 AS x FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i, list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE)) AS s FROM embeddings)")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(vectors.l2_normalize(F.col("embedding"))).alias("i", "x"))
    return rows.select("vec_id", F.col("i").cast("long").alias("i"), (F.round("x", 4) + 0.0).alias("x"))


@_query(
    """SELECT text_no, i, round(sum(x * m) / greatest(sum(m), 1), 4) + 0.0 AS x FROM (
      SELECT vec_id // 16 AS text_no, CASE WHEN vec_id % 3 <> 0 THEN 1 ELSE 0 END AS m, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY text_no, i"""
)
def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of unmasked vectors over texts of sixteen tokens, every third of them masked."""
    rows = _table(spark, sf_dir, "embeddings")
    dim = rows.select(F.max(F.size("embedding")).alias("n")).first().n
    token = F.struct("vec_id", F.col("embedding").alias("v"), (F.col("vec_id") % 3 != 0).cast("double").alias("m"))
    texts = rows.groupBy(F.floor(F.col("vec_id") / 16).alias("text_no")).agg(F.array_sort(F.collect_list(token)).alias("tokens"))
    pooled = texts.select("text_no", F.posexplode(vectors.mean_pool(F.col("tokens.v"), F.col("tokens.m"), dim)).alias("i", "x"))
    return pooled.select("text_no", F.col("i").cast("long").alias("i"), (F.round("x", 4) + 0.0).alias("x"))


DIM = 8


def _sql_component(j: int) -> str:
    return f"('0x' || substr(md5(w || '#{j // 5}'), {6 * (j % 5) + 1}, 6))::BIGINT / 16777215.0 * 2 - 1"


_EMBED_SQL = f"""
  SELECT doc_id, {", ".join(f"round(v{j} / sqrt(greatest({' + '.join(f'v{k} * v{k}' for k in range(DIM))}, 1e-12)), 4) + 0.0 AS e{j}" for j in range(DIM))} FROM (
    SELECT doc_id, {", ".join(f"avg(({_sql_component(j)})::DOUBLE) AS v{j}" for j in range(DIM))}
    FROM (SELECT doc_id, unnest(string_split(norm_text, ' ')) AS w FROM ({_NORM_DOCS_SQL}) WHERE norm_text IS NOT NULL) GROUP BY doc_id)
"""


#: 0.0 is added to rounded values, as one engine may say -0.0 where another says 0.0.
def _spread(df: DataFrame) -> DataFrame:
    return df.select("doc_id", *[(F.round(F.get("v", F.lit(j)), 4) + 0.0).alias(f"e{j}") for j in range(DIM)])


@_query(_EMBED_SQL)
def embed_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(hash_vectors(_norm_docs(spark, sf_dir), "doc_id", DIM))


@_query(_EMBED_SQL)
def embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(dedup.once_per_text(_norm_docs(spark, sf_dir), "norm_text", lambda texts: hash_vectors(texts, "norm_text", DIM)))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.concat(F.lit("doc-"), "doc_id").alias("id"), "text")


@_query(f"SELECT CASE WHEN norm_text IS NULL THEN 'skipped' ELSE 'ok' END AS status, count(*) AS n FROM ({_NORM_DOCS_SQL}) GROUP BY 1")
def embed_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.status_counts(Engine(EmbedConfig(dedup_capacity=1)).plan(_messages(spark, sf_dir)))


@_query(f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_no, 'doc-' || doc_id AS id FROM ({_NORM_DOCS_SQL}) WHERE norm_text IS NOT NULL")
def ordered_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Engine().plan(_messages(spark, sf_dir)).where("status = 'ok'").select("seq", "id")
    return text.dense_seq(store(rows, "ok"), "seq", name="row_no").select("row_no", "id")


@_query(f"SELECT 'doc-' || doc_id AS id, {DIM}::BIGINT AS dim, true AS same FROM ({_NORM_DOCS_SQL}) WHERE norm_text IS NOT NULL")
def parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written and read back, each held against the result that was written."""
    folder = work_dir(spark, "vectors.parquet")
    made = Engine().embed(_messages(spark, sf_dir)).df
    sinks.write_vectors(made, folder, DIM)
    back = spark.read.parquet(folder).join(made.select("id", F.col("embedding").alias("made")), "id", "left")
    return back.select("id", F.size("embedding").cast("long").alias("dim"), F.col("embedding").eqNullSafe(F.col("made")).alias("same"))


@_query(f"SELECT count(*)::BIGINT AS rows, {DIM}::BIGINT AS dim, 128 + 4 * {DIM} * count(*)::BIGINT AS bytes FROM ({_NORM_DOCS_SQL}) WHERE norm_text IS NOT NULL")
def npy_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as one file; its header and values are held against the result, row by row in order of seq."""
    path = work_dir(spark, "vectors.npy")
    made = Engine().embed(_messages(spark, sf_dir)).df
    rows = sinks.write_npy(made, path, DIM)
    ok = text.dense_seq(made.where("status = 'ok'").select("seq", F.col("embedding").alias("made")), "seq", name="at")
    fs, written = hadoop_path(spark, path)
    same = sinks.read_npy(spark, path, DIM).join(ok, "at", "full").agg(F.count_if(~F.col("found").eqNullSafe(F.col("made"))).alias("n")).first().n
    if same:
        raise AssertionError(f"{same} vectors differ")
    return spark.createDataFrame([(rows, DIM, fs.getFileStatus(written).getLen())], "rows long, dim long, bytes long")


@_query(
    f"""SELECT count(norm_text) AS processed, count(*) - count(norm_text) AS skipped, 0::BIGINT AS failed, count(norm_text) - count(DISTINCT norm_text) AS dedup_hits, count(DISTINCT norm_text) AS dedup_size
    FROM ({_NORM_DOCS_SQL})"""
)
def stats_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Engine(EmbedConfig(dedup_capacity=1)).embed(_messages(spark, sf_dir)).stats()
    row = (s.messages_processed, s.messages_skipped, s.messages_failed, s.dedup_hits, s.dedup_size)
    return spark.createDataFrame([row], "processed long, skipped long, failed long, dedup_hits long, dedup_size long")


@_query(
    """SELECT count(*) AS n, min(x) AS min, list_sort(list(x))[least(floor(count(*) * 0.5::DOUBLE), count(*) - 1)::BIGINT + 1] AS p50,
      list_sort(list(x))[least(floor(count(*) * 0.95::DOUBLE), count(*) - 1)::BIGINT + 1] AS p95, list_sort(list(x))[least(floor(count(*) * 0.99::DOUBLE), count(*) - 1)::BIGINT + 1] AS p99,
      max(x) AS max, round(avg(x), 4) AS mean FROM (SELECT value::DOUBLE AS x FROM events WHERE value IS NOT NULL)"""
)
def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latency_stats(_table(spark, sf_dir, "events"), "value").withColumn("mean", F.round("mean", 4))


@_query("SELECT event_type, n, round(n / (SELECT count(*) FROM events WHERE event_type = 'click'), 2) AS speed_up FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)")
def speed_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = _table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    base = rates.where("event_type = 'click'").agg(F.coalesce(F.max("n"), F.lit(0)).alias("base"))
    return metrics.speed_up(rates.crossJoin(F.broadcast(base)), "n", "base").drop("base")  # one row


@_query(f"SELECT 'doc-' || doc_id AS id, CASE WHEN norm_text IS NULL THEN 'skipped' ELSE 'ok' END AS status FROM ({_NORM_DOCS_SQL}) WHERE doc_id IN (SELECT doc_id FROM documents WHERE strlen(text) >= 10)")
def stream_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSONL files, embedded as a stream."""
    from ..streaming.embed import embed_stream, read_stream

    folder = work_dir(spark, "stream")
    _messages(spark, sf_dir).select("id", "text").write.json(f"{folder}/in")
    query = embed_stream(read_stream(spark, f"{folder}/in"), Engine(EmbedConfig(dedup_capacity=1)), f"{folder}/out", f"{folder}/state")
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return spark.read.schema("id string, status string").parquet(*[f"{folder}/out"]).select("id", "status")
