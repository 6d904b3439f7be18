"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source starts with the same expected number of copies, its source's target
over its source's size. The whole part is taken; the fractional parts are rounded in pairs: mass
moves at random from one document of a pair to the other, in words, until one of them is whole,
which keeps every document's expectation and the pair's sum of words. Leaves of a reduction tree
do this for bounded groups of documents, many pairs at a time, and leave one fractional document
each; the next level pairs those, up to one document a source, which a coin decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.sources.text import dense_seq

from .common import n_words, quoted, row_digest, shuffle_partitions, store, unused, within

#: Documents of a leaf, and residuals of an inner node of the tree, in expectation.
LEAF = 512
#: Sources whose table the driver makes and sends to every task; a table of more is made and joined by the tasks.
DRIVER_SOURCES = 100_000
#: Rows that one row is repeated to in one task; more are dealt out first.
REPEATS = 1_000


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = (1, 2, 3), *, epochs: int = 3, budget: int | None = None) -> dict[str | None, float]:
    """Words to take from each source.

    Sources by code point, null last, weigh ``weights``, repeating, and share ``budget`` (all
    words where None). A target stops at ``epochs`` times its source's size; the excess goes to
    the others by weight until none is above. Sources without words get none.
    """
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(order)}
    left = Fraction(sum(sizes.values()) if budget is None else budget)
    out: dict[str | None, Fraction] = {}
    free = set(order)
    while free:
        total = sum(weight[s] for s in free)
        if not total:
            break
        full = {s for s in free if left * weight[s] / total >= epochs * sizes[s]}
        if not full:
            out |= {s: left * weight[s] / total for s in free}
            break
        out |= {s: Fraction(epochs * sizes[s]) for s in full}
        left -= sum(out[s] for s in full)
        free -= full
    return {s: float(out.get(s, 0)) for s in order}


def _shares(per_source: DataFrame, weights: tuple[float, ...], epochs: int, budget: int | None) -> DataFrame:
    """``per_source`` (source, source_size, rows; stored) with rank, leaves, target and rate."""
    if per_source.count() > DRIVER_SOURCES:
        given = _filled(per_source, weights, epochs, budget)
    else:
        found = per_source.collect()
        goal = targets({r.source: r.source_size for r in found}, weights, epochs=epochs, budget=budget)
        rows = [(r.source, i, r.source_size, goal[r.source], r.rows) for i, r in enumerate(sorted(found, key=lambda r: (r.source is None, r.source or "")))]
        given = per_source.sparkSession.createDataFrame(rows, "source string, rank long, source_size long, target double, rows long")
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(epochs)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    return given.select("source", "rank", "source_size", "target", F.ceil(F.col("rows") / LEAF).alias("leaves"), rate.alias("rate"))


def _filled(per_source: DataFrame, weights: tuple[float, ...], epochs: int, budget: int | None) -> DataFrame:
    """``targets`` for any number of sources: the level up to which they are filled is raised until no more of them stop there.

    Each step is one aggregate over the sources.
    """
    ranked = dense_seq(per_source.select(F.col("source").isNull().cast("int").alias("no_source"), "*"), "no_source", "source", name="rank").drop("no_source")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int"))
    ranked = store(ranked.withColumn("weight", weight).withColumn("most", F.lit(epochs) * F.col("source_size")), "sources")
    whole = F.col("most").cast("decimal(38,0)")
    level, before = -1.0, None
    while True:
        full = F.col("most") <= F.col("weight") * F.lit(level)
        r = ranked.agg(F.count_if(full).alias("n"), F.sum(F.when(full, whole)).alias("stopped"), F.sum(F.when(~full, F.col("weight"))).alias("free"), F.sum(F.col("source_size").cast("decimal(38,0)")).alias("words")).first()
        if r.n == before or not r.free:
            break
        left = Fraction(int(r.words or 0) if budget is None else budget) - int(r.stopped or 0)
        level, before = float(left / Fraction(r.free)), r.n
    target = F.least(F.col("most").cast("double"), F.col("weight") * F.lit(max(level, 0.0)))
    return ranked.select("source", "rank", "source_size", target.alias("target"), "rows")


def _uniform(key: np.ndarray, step: int) -> np.ndarray:
    """Numbers from 0 to 1 that follow from ``key`` and ``step``."""
    with np.errstate(over="ignore"):
        x = key.view(np.uint64) + np.uint64(step + 1) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def pivot(leaf: np.ndarray, words: np.ndarray, share: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Round the shares of whole leaves (equal numbers of ``leaf`` lie together) until each leaf has at most one fraction.

    In every step neighbours that are fractions are paired; words move from one to the other, at
    random, until one is 0 or 1: up with the odds that keep both expectations.
    """
    f = share.copy()
    at = np.flatnonzero((f > 0) & (f < 1))
    step = 0
    while len(at) > 1:
        new = np.append(True, leaf[at[1:]] != leaf[at[:-1]])
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        left = np.flatnonzero(((np.arange(len(at)) - first) % 2 == 0)[:-1] & ~new[1:])
        if not len(left):
            break
        a, b = at[left], at[left + 1]
        to_a, to_b = words[a] * (1 - f[a]), words[b] * (1 - f[b])  # what each may gain
        of_a, of_b = words[a] * f[a], words[b] * f[b]  # and give
        up, down = np.minimum(to_a, of_b), np.minimum(of_a, to_b)
        rise = _uniform(key[b], step) * (up + down) < down
        fa = np.where(rise, f[a] + up / words[a], f[a] - down / words[a])
        fb = np.where(rise, f[b] - up / words[b], f[b] + down / words[b])
        fa = np.where(rise & (to_a <= of_b), 1.0, np.where(~rise & (of_a <= to_b), 0.0, fa))
        fb = np.where(rise & (of_b <= to_a), 0.0, np.where(~rise & (to_b <= of_a), 1.0, fb))
        f[a], f[b] = np.clip(fa, 0, 1), np.clip(fb, 0, 1)
        at = at[(f[at] > 0) & (f[at] < 1)]
        step += 1
    return f


def _pivoted(units: DataFrame, last: bool) -> DataFrame:
    """``units`` (rank, leaf, key, size, share, ...) with rounded shares; at the tree's root a number decides the last fraction."""
    schema = _nullable(units.schema)
    place = {n: i for i, n in enumerate(schema.names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rounded(table: pa.Table) -> Iterator[pa.RecordBatch]:
            of = {n: table.column(n).to_numpy() for n in ("rank", "leaf", "key", "size", "share")}
            both = np.stack([of["rank"], of["leaf"]])
            leaf = np.cumsum(np.append(True, (both[:, 1:] != both[:, :-1]).any(0)))
            f = pivot(leaf, of["size"].astype(float), of["share"], of["key"])
            if last:
                f = np.where((f > 0) & (f < 1), _uniform(of["key"], 63) < f, f)
            yield from table.set_column(place["share"], "share", pa.array(f, pa.float64())).to_batches()

        held: list[pa.RecordBatch] = []  # the leaf that the next batch may go on with
        for b in batches:
            if not b.num_rows:
                continue
            ends = [b.column(place[n]).to_numpy(zero_copy_only=False) for n in ("rank", "leaf")]
            cut = int(np.flatnonzero((ends[0] != ends[0][-1]) | (ends[1] != ends[1][-1])).max(initial=-1)) + 1
            if cut:
                yield from rounded(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held = []
            elif held and any(held[-1].column(place[n])[-1].as_py() != x[0] for n, x in zip(("rank", "leaf"), ends)):
                yield from rounded(pa.Table.from_batches(held))
                held = []
            held.append(b.slice(cut))
        if held:
            yield from rounded(pa.Table.from_batches(held))

    # Sorted streams, not groups: a task holds one leaf and one batch.
    dealt = units.repartition(shuffle_partitions(units.sparkSession), "rank", "leaf").sortWithinPartitions("rank", "leaf", "key", "size")
    return dealt.mapInArrow(run, schema)


def _rounded(sizes: DataFrame, weights: tuple[float, ...], epochs: int, budget: int | None, seed: int) -> DataFrame:
    """``sizes`` (doc_id, source, size, key0, key1, n: equal rows) with the source's source_size and target, and copies and extra.

    Each of a unit's n rows is taken ``copies`` times, and ``extra`` of them once more. A unit's
    own rows pair first: of n equal fractions all but the rest of their sum is whole.
    """
    per_source = store(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("rows")), "per_source")
    table = store(_shares(per_source, weights, epochs, budget), "shares")
    top = table.agg(F.count("*").alias("n"), F.max("leaves").alias("leaves")).first()
    named = table.toDF("t_source", *table.columns[1:])
    named = F.broadcast(named) if top.n <= DRIVER_SOURCES else named
    mine = F.when(F.col("size") > 0, F.col("rate")).otherwise(0.0)
    part = F.col("n") * (mine - F.floor(mine))
    units = sizes.join(named, sizes.source.eqNullSafe(F.col("t_source"))).select(
        "rank",
        F.pmod(F.xxhash64(F.lit(seed), "doc_id", "key0", "key1", "size"), "leaves").alias("leaf"),
        _key(seed, 0).alias("key"),
        "size",
        (part - F.floor(part)).alias("share"),
        "doc_id",
        "key0",
        "key1",
        "n",
        F.floor(mine).cast("long").alias("copies"),
        F.floor(part).cast("long").alias("extra"),
    )
    level, most, whole = 0, top.leaves or 1, []
    while True:
        done = store(_pivoted(units, most <= 1), f"level{level}")
        whole.append(done.where("share = 0 or share = 1"))
        if most <= 1:
            break
        level, most = level + 1, math.ceil(most / LEAF)
        units = done.where("share > 0 and share < 1").withColumn("leaf", F.floor(F.col("leaf") / LEAF)).withColumn("key", _key(seed, level))
    out = whole[0]
    for more in whole[1:]:
        out = out.unionByName(more)
    plain = table.select(F.col("rank").alias("t_rank"), "source", "source_size", "target")
    plain = F.broadcast(plain) if top.n <= DRIVER_SOURCES else plain
    extra = F.col("extra") + F.col("share").cast("long")
    return out.join(plain, F.col("rank") == F.col("t_rank")).select("doc_id", "key0", "key1", "source", "size", "source_size", "target", "n", "copies", extra.alias("extra"))


def _key(seed: int, level: int) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(level + 1), "doc_id", "key0", "key1", "size", "rank")


def _repeated(df: DataFrame, count: str, name: str) -> DataFrame:
    """Every row ``count`` times, numbered from 0 in ``name``; what is repeated often is dealt out on the way."""
    n = F.col(quoted(count)).cast("long")
    few = df.where((n > 0) & (n <= REPEATS)).withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    many = df.where(n > REPEATS).withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(REPEATS).cast("long")))).repartition(shuffle_partitions(df.sparkSession))
    at = F.col(quoted(name))
    return few.unionByName(many.withColumn(name, F.explode(F.sequence(at, F.least(at + REPEATS, n) - 1))))


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (1, 2, 3),
    epochs: int = 3,
    budget: int | None = None,
    seed: int = 11,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    A source's taken words differ from its target by at most its largest document, and no
    document is taken more than ``epochs`` times. Decisions depend on the rows' values and
    ``seed`` only, not on how rows are partitioned, so reruns agree. Rows equal in all columns
    are rounded one by one like any others; which of them is taken more often can't be told.
    Null and wordless texts have size 0 and are taken 0 times; very long texts are counted whole;
    a null source is a source of its own and a null id an id like any other. Extra columns may
    have any names; an empty table gives no rows.
    """
    sizes = _sizes(docs, id_col, text_col, source_col)
    rows = _repeated(_rounded(sizes, weights, epochs, budget, seed), "n", "row")
    copies = F.col("copies") + (F.col("row") < F.col("extra")).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, size, key0, key1, n): rows equal in all columns, counted."""
    key = [k.alias(f"key{i}") for i, k in enumerate(row_digest(docs))]
    each = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col).cast("string")).alias("size"), *key)
    return store(each.groupBy("doc_id", "source", "size", "key0", "key1").agg(F.count("*").alias("n")), "sizes")


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def mixed(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (1, 2, 3),
    epochs: int = 3,
    budget: int | None = None,
    seed: int = 11,
) -> DataFrame:
    """``docs`` with every row as often as a mix takes it, same columns; rows taken 0 times go.

    Rows are told apart by a digest of all columns, as by ``mix``, and taken as often.
    """
    sizes = _sizes(docs, id_col, text_col, source_col)
    plan = store(_rounded(sizes, weights, epochs, budget, seed).select("key0", "key1", "n", "copies", "extra"), "plan")
    n, times, k0, k1 = (unused(x, docs) for x in ("row", "times", "key0", "key1"))
    row = [F.col(quoted(c)) for c in docs.columns]
    each = F.when(F.col("n") == 1, F.col("copies") + F.col("extra")).otherwise(F.col("copies"))
    often = plan.select(F.col("key0").alias(k0), F.col("key1").alias(k1), each.alias(times)).where(F.col(times) > 0)
    at = [a == F.col(quoted(b)) for a, b in zip(row_digest(docs), (k0, k1))]
    out = _repeated(docs.join(often, at[0] & at[1]), times, n).select(*row)
    # Of rows that are equal in all columns, some once more: one of them is repeated instead.
    more = plan.where("n > 1 and extra > 0").select("key0", "key1", "extra")
    if more.isEmpty():
        return out
    keyed = within(docs, row_digest(docs), more.select("key0", "key1")).select(*[k.alias(f"key{i}") for i, k in enumerate(row_digest(docs))], F.struct(*row).alias("row"))
    one = keyed.groupBy("key0", "key1").agg(F.first("row").alias("row")).join(more, ["key0", "key1"]).select("row", "extra")
    return out.unionByName(_repeated(one, "extra", "n").select("row.*"))
