"""Quality rules: per-text counts, and lines that too many documents of a host share.

Normalised lines are hashed; distinct documents are counted for each host and line; lines above
the host's limit are taken out, and documents that little is left of are rejected. Documents of a
host whose normalised lines are the same, one after another, are one document, so that copies of
a text, however many, do not make its lines boilerplate. Nothing else is told apart from plain
counts: a text that many documents of a host repeat with changes is above the limit, too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_KEYS, digest, drop, store, without

#: A line is above the limit when more distinct documents of its host hold it than this number...
MIN_DOCS = 10
#: ...and more than this share of the host's distinct documents.
MIN_SHARE = 0.005
#: A document is depleted when less than this share of its words is left.
LEFT_SHARE = 0.3

_SYMBOLS = bytes(b"#*$%&|<>")
_NOT_SYMBOLS = bytes(set(range(256)) - set(_SYMBOLS))

METRICS = T.StructType(
    [
        T.StructField("n_words", T.LongType(), False),
        T.StructField("word_chars", T.LongType(), False),
        T.StructField("n_symbols", T.LongType(), False),
        T.StructField("n_dup_lines", T.LongType(), False),
        T.StructField("n_repeat_words", T.LongType(), False),
        T.StructField("lines_hash", T.LongType(), False),
        T.StructField("line_hash", T.ArrayType(T.LongType(), False), False),
        T.StructField("line_words", T.ArrayType(T.LongType(), False), False),
    ]
)


def _repeat_words(tokens: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more in the text."""
    n = len(tokens)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in tokens), np.int64, n)
    v = len(number)
    if v == n:
        return 0
    pair = ids[:-1] * v + ids[1:]
    # Exact numbers for windows: v is at most n, and v * v * v may pass 64 bits only beyond two million words.
    if v < 2_000_000:
        window = pair[:-1] * v + ids[2:]
    else:
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        window = pair[:-1] * v + ids[2:]
    order = np.argsort(window, kind="stable")
    ordered = window[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = np.zeros(n, bool)
    inside[:-2] |= twice
    inside[1:-1] |= twice
    inside[2:] |= twice
    return int(inside.sum())


def measure(text: bytes) -> tuple[int, int, int, int, int, int, list[int], list[int]]:
    """The METRICS of one text; line_hash has each distinct line with a word once, line_words its words in all."""
    import xxhash

    tokens = text.split()
    chars = sum(map(len, tokens))
    if not text.isascii():
        chars -= len(text.translate(None, _NOT_CONTINUED))
    lines: dict[bytes, None] = {}
    weight: dict[bytes, int] = {}
    whole = xxhash.xxh64()
    dup = 0
    for line in text.split(b"\n"):
        words = line.split()
        if not words:
            continue
        if line in lines:
            dup += 1
        lines[line] = None
        normal = b" ".join(words).lower()
        weight[normal] = weight.get(normal, 0) + len(words)
        whole.update(normal + b"\n")
    hashes = np.array([xxhash.xxh64_intdigest(x) for x in weight], np.uint64).view(np.int64).tolist()
    return (
        len(tokens),
        chars,
        len(text.translate(None, _NOT_SYMBOLS)),
        dup,
        _repeat_words(tokens),
        int(np.uint64(whole.intdigest()).view(np.int64)),
        hashes,
        list(weight.values()),
    )


#: All bytes but UTF-8's continuation bytes.
_NOT_CONTINUED = bytes(set(range(256)) - set(range(0x80, 0xC0)))


def metrics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host, key0 and key1 (the text's digest), and METRICS of every row's whole text; null is the empty text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = [k.alias(f"key{i}") for i, k in enumerate(digest(text))]
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), *key, text.alias("text"))
    schema = T.StructType([*slim.schema.fields[:4], *METRICS.fields])
    kinds = [pa.int64()] * 6 + [pa.list_(pa.int64())] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measure(t.as_buffer().to_pybytes()) for t in b.column(4)]
            columns = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *(pa.array(c, k) for c, k in zip(columns, kinds))], names=schema.names)

    return slim.mapInArrow(run, schema)


def boilerplate(measured: DataFrame, *, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, line): hashed lines that more distinct documents of their host hold than its limit.

    A host and line's documents are counted in two steps, each combined before its shuffle, so
    that neither a host nor a line of many rows meets in one task.
    """
    docs = measured.select("host", "lines_hash").distinct().groupBy("host").agg(F.count("*").alias("docs"))
    limits = docs.select("host", F.greatest(F.lit(float(min_docs)), F.col("docs") * F.lit(float(min_share))).alias("most"))
    lines = measured.select("host", "lines_hash", F.explode("line_hash").alias("line")).distinct()
    held = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > min_docs)
    at = held.host.eqNullSafe(limits.host) & (held.n > limits.most)
    return held.join(limits, at, "left_semi").select("host", "line")


def judge(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_docs: int = MIN_DOCS,
    min_share: float = MIN_SHARE,
    left_share: float = LEFT_SHARE,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, the base counts, base_failed, n_removed_words, kept.

    base_failed: fewer than 50 words, or over half of them in repeated 3-word windows. kept: not
    base_failed, and at least ``left_share`` of the words left without lines above the limit. A
    line is above it when more than ``min_docs`` distinct documents of the host hold it, and more
    than ``min_share`` of them; a line with exactly as many stays. Null and empty texts have no
    words and fail. Very long texts are read whole. A null host is a host of its own; a null or
    repeated id is an id like any other, as rows are judged by host and text; rows repeated in
    whole count as one document and are judged alike. Extra columns, whatever their names, are
    ignored; an empty table gives no rows.
    """
    return _judged(store(metrics(docs, id_col=id_col, text_col=text_col, host_col=host_col), "metrics"), min_docs, min_share, left_share).select(*VERDICT)


#: The columns of a verdict.
VERDICT = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


def _judged(measured: DataFrame, min_docs: int, min_share: float, left_share: float) -> DataFrame:
    bad = store(boilerplate(measured, min_docs=min_docs, min_share=min_share), "boilerplate")
    named = bad.select(F.col("host").alias("bad_host"), F.col("line").alias("bad_line"))
    named = F.broadcast(named) if bad.count() <= BROADCAST_KEYS else named
    own = measured.select("host", "key0", "key1", F.explode(F.arrays_zip("line_hash", "line_words")).alias("l"))
    lines = own.select("host", "key0", "key1", F.col("l.line_hash").alias("line"), F.col("l.line_words").alias("words"))
    hit = lines.join(named, (F.col("line") == F.col("bad_line")) & F.col("host").eqNullSafe(F.col("bad_host")), "left_semi")
    removed = hit.distinct().groupBy("host", "key0", "key1").agg(F.sum("words").alias("removed")).toDF("r_host", "r_key0", "r_key1", "removed")
    m = measured.drop("line_hash", "line_words", "lines_hash")
    out = m.join(removed, (F.col("key0") == F.col("r_key0")) & (F.col("key1") == F.col("r_key1")) & F.col("host").eqNullSafe(F.col("r_host")), "left")
    gone = F.coalesce("removed", F.lit(0))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = ~failed & (F.col("n_words") - gone >= left_share * F.col("n_words"))
    return out.select(*m.columns, failed.alias("base_failed"), kept.alias("kept"), gone.alias("n_removed_words"))


def keep_good(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_docs: int = MIN_DOCS,
    min_share: float = MIN_SHARE,
    left_share: float = LEFT_SHARE,
) -> DataFrame:
    """``docs`` without the rows that ``judge`` rejects, same columns.

    Rows go by host and text, on which their verdicts depend, whatever their ids. The texts'
    counts are removed once the keys to drop are known.
    """
    measured = store(metrics(docs, id_col=id_col, text_col=text_col, host_col=host_col), "metrics")
    verdicts = _judged(measured, min_docs, min_share, left_share)
    bad = store(verdicts.where(~F.col("kept")).select("host", "key0", "key1").distinct(), "rejected")
    drop(measured)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return without(docs, [F.col(host_col).cast("string"), *digest(text)], bad)
