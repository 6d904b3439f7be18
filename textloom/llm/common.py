"""What the corpus operators have in common: words, folds, connected components."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.shared import drop, hadoop_path, remove, shared_dir, shuffle_partitions, store, work_dir

__all__ = [
    "BROADCAST_KEYS",
    "connected_components",
    "crc_fold",
    "digest",
    "drop",
    "hadoop_path",
    "lower_ascii",
    "n_words",
    "quoted",
    "remove",
    "row_digest",
    "shared_dir",
    "shuffle_partitions",
    "store",
    "told",
    "unused",
    "within",
    "without",
    "work_dir",
]

#: ASCII white space, the only separator of words.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def n_words(text: Column) -> Column:
    """Number of words; null counts as no text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


#: Row keys that are sent to every task: a few longs each, and a few times that in a hash table.
BROADCAST_KEYS = 2_000_000


def unused(stem: str, *frames: DataFrame) -> str:
    """A column name that none of ``frames`` has, whatever the case of its letters."""
    taken = {c.lower() for f in frames for c in f.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def digest(*values: Column) -> list[Column]:
    """Two 64-bit hashes of ``values`` with independent seeds: rows equal in both are taken as equal."""
    return [F.xxhash64(*values), F.xxhash64(F.lit(1), *values)]


def row_digest(docs: DataFrame) -> list[Column]:
    """``digest`` of all columns; what can't be hashed as it is (maps) is hashed as JSON. Nulls are told from empty values."""
    cells = []
    for f in docs.schema.fields:
        c = F.col(quoted(f.name))
        plain = not any(t in f.dataType.simpleString() for t in ("map<", "variant", "geo"))
        cells += [c.isNull(), c if plain else F.to_json(F.struct(c.alias("v")))]
    return digest(*cells)


def without(docs: DataFrame, key: list[Column], gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``key`` (expressions over ``docs``) is a row of ``gone`` (stored, each once)."""
    return _by_key(docs, key, gone, "left_anti")


def within(docs: DataFrame, key: list[Column], kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``key`` is a row of ``kept`` (stored, each once)."""
    return _by_key(docs, key, kept, "left_semi")


def _by_key(docs: DataFrame, key: list[Column], keys: DataFrame, how: str) -> DataFrame:
    """The keys are counted: up to BROADCAST_KEYS go to the rows; beyond, the rows are shuffled to the keys. Nulls equal nulls."""
    few = keys.count() <= BROADCAST_KEYS
    named = keys.toDF(*[unused(f"key{i}", docs) for i in range(len(key))])
    named = F.broadcast(named) if few else named.hint("merge")
    same = [k.eqNullSafe(F.col(quoted(n))) for k, n in zip(key, named.columns, strict=True)]
    return docs.join(named, reduce(and_, same), how)


def told(rows: DataFrame, table: DataFrame, key: str, value: str, hot_parts: int = 10_000) -> DataFrame:
    """``rows`` with ``value`` of ``table`` (key, value, n; stored), where ``n`` is how many rows a key has.

    Keys of more than this part of all rows, fewer than ``hot_parts``, are told by broadcast, so
    that their rows never meet in one task; the others are joined.
    """
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    large = F.col("n") > total // hot_parts
    hot = F.broadcast(table.where(large).select(key, value))
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(table.where(~large).select(key, value), key))


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of every node that ``edges`` (a, b; any ordered type) touches.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each step is an
    aggregation by node, joined back, so that no node's neighbours ever meet in one task, and
    the number of rounds grows with the logarithm of the longest path. Every round is written to
    the shared folder; the one before is removed. Returns (node, component).
    """
    hi, lo = F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")
    flat = edges.where("a is not null and b is not null")
    now = store(flat.where("a <> b").select(hi, lo).distinct(), "edges")
    loops = flat.where("a = b").select(F.col("a").alias("node"))
    before = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s")).first()
        if seen == before or not seen.n:
            break
        before = seen
        # Large-star: a node hands its smallest neighbour to the larger ones.
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = large.distinct()
        # Small-star: a node hands it to the smaller ones and to itself.
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        after = store(small.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
        drop(now)
        now = after
    nodes = now.groupBy("hi").agg(F.min("lo").alias("component")).select(F.col("hi").alias("node"), "component")
    roots = now.select(F.col("lo").alias("node")).distinct().select("node", F.col("node").alias("component"))
    alone = loops.select("node", F.col("node").alias("component"))
    return nodes.unionByName(roots).unionByName(alone).groupBy("node").agg(F.min("component").alias("component"))
