"""Links between texts whose sets of word shingles overlap by a given share (Jaccard).

A SimHash ball can't reach this far: at a similarity of 0.8 two 64-bit fingerprints differ in about
ten bits, and a ball of half that radius has millions of variants. So most links come from bands of
min-hashes, and an exact prefix index finds those between the components that the bands leave. Every
candidate pair that parities of its shingles don't exclude is verified on the whole sets.

The index: sort each set by one order of all shingles. Two sets that overlap by a share t have t of
either in common, so the first 1 - t of each, and one more, share a shingle. Any order will do; with
rare shingles first few other pairs meet.
"""

from __future__ import annotations

from itertools import chain
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, connected_components, drop, store, told, within

#: Bands and min-hashes a band: a pair at a similarity of 0.8 shares a band with probability 0.997.
BANDS, ROWS = 32, 8
#: Rounds of leaders at most; what they leave is found by the index.
ROUNDS = 4
_BLOCK = 4096
#: Shingles are counted in one of so many rows, and at most so many counts order them: this bears on the time only.
SAMPLE, COUNTED = 8, 500_000
#: Bits of a set's parity bitmap.
BITS = 1024
#: Rows of one shingle that meet in one place; larger groups are split into cells of two such blocks.
MEET = 4096
#: Allows for rounding where a share is multiplied: a bound may be too wide by this, never too narrow.
_SLACK = 1e-6
_LONGS = pa.list_(pa.int64())


def _shingles(text: bytes, words: int, seed: int) -> np.ndarray:
    """Distinct hashes of the shingles, sorted; fewer words are one shingle, none are none."""
    import xxhash

    tokens = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not tokens:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(tokens) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], seed) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())], np.uint64))


def _draws(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    flips, odd, mix = (rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64) for _ in range(3))
    return flips, odd | np.uint64(1), mix | np.uint64(1)


def _band_keys(shingles: np.ndarray, draws: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    flips, odd, mix = draws
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), _BLOCK):
        part = (shingles[at : at + _BLOCK, None] ^ flips) * odd
        np.minimum(least, part.min(0), out=least)
    keys = (least * mix).reshape(BANDS, ROWS).sum(1, dtype=np.uint64)
    return (keys ^ np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _prefix(shingles: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first of the shingles, by their counts in ``common``, then by hash: sets that overlap by ``similarity`` share one."""
    known, counts = common
    seen = np.zeros(len(shingles), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
        seen = np.where(known[at] == shingles, counts[at], 0)
    most = len(shingles) - ceil(similarity * len(shingles) - _SLACK) + 1
    return shingles[np.lexsort((shingles, seen))[:most]]


def _parity(shingles: np.ndarray) -> bytes:
    """Whether each of BITS classes of shingles has an odd number: two sets' bitmaps differ in no more bits than the sets in shingles."""
    odd = np.bincount((shingles % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _classes(shingles: np.ndarray) -> np.ndarray:
    """The same parities for a power of two of classes, no fewer than shingles, as longs: a few bits a shingle, so that large sets tell too."""
    n = 1 << max(6, (len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _by_text(docs: DataFrame, key: list[Column], text_col: str, columns: dict[str, pa.DataType], make) -> DataFrame:
    """(key0, key1, ``columns``) of every row whose text has a word; ``make`` maps a text's bytes to the columns' values, or to None."""
    own = docs.select(*[k.alias(f"key{i}") for i, k in enumerate(key)], F.col(text_col).cast("string").alias("text"))
    names = {pa.int64(): "long", _LONGS: "array<long>", pa.binary(): "binary"}

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                made = [make(t.as_buffer().to_pybytes()) if t.is_valid else None for t in part.columns[2]]
                there = pa.array([m is not None for m in made], pa.bool_())
                values = [pa.array([m[i] for m in made if m is not None], t) for i, t in enumerate(columns.values())]
                yield pa.RecordBatch.from_arrays([part.columns[0].filter(there), part.columns[1].filter(there), *values], names=["key0", "key1", *columns])

    return own.mapInArrow(run, ", ".join(["key0 long, key1 long", *(f"{n} {names[t]}" for n, t in columns.items())]))


def _sets(docs: DataFrame, key: list[Column], text_col: str, words: int, seed: int) -> DataFrame:
    def make(text: bytes):
        found = _shingles(text, words, seed)
        return (found.view(np.int64),) if len(found) else None

    return _by_text(docs, key, text_col, {"shingles": _LONGS}, make)


def _common(docs: DataFrame, key: list[Column], text_col: str, words: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, sorted; counts): the commonest of the rows of a hashed sample."""
    some = _sets(docs.where(F.pmod(key[0], F.lit(SAMPLE)) == 0), key, text_col, words, seed)
    counts = store(some.select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    least, total = None, 0
    for n, of in sorted(((r.n, r["of"]) for r in counts.groupBy("n").agg(F.count("*").alias("of")).collect()), reverse=True):
        total += of
        if total > COUNTED:
            break
        least = n
    if least is None:
        drop(counts)
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    rows = counts.where(F.col("n") >= least).toArrow()
    drop(counts)
    known = rows.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(known)
    return known[order], rows.column("n").to_numpy()[order]


def similar_links(docs: DataFrame, key: list[Column], *, text_col: str = "text", words: int = 5, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """(a, b): structs of ``key`` (two longs that tell rows apart) of rows whose shingle sets overlap by ``similarity`` or more.

    The links connect just the rows that all pairs connect; rows that are connected by others may
    get no link of their own. Rows that share a band are compared with the band's leader, the one
    that most others share bands with, so that no group emits all its pairs. Those that the leader
    doesn't link are compared with the next one, for a few rounds. Then the prefix index compares,
    between components, all rows that may reach the similarity. All links are verified on whole
    texts. Texts without words, null or not, have no links; an empty table has none.
    """
    draws, common = _draws(seed), _common(docs, key, text_col, words, seed)

    def make(text: bytes):
        found = _shingles(text, words, seed)
        if not len(found):
            return None
        return _band_keys(found, draws), len(found), _prefix(found, common, similarity).view(np.int64), _parity(found), _classes(found)

    columns = {"bands": _LONGS, "size": pa.int64(), "prefix": _LONGS, "bits": pa.binary(), "classes": _LONGS}
    sketches = store(_by_text(docs, key, text_col, columns, make), "sketches")
    by_bands = _band_links(docs, key, text_col, words, seed, similarity, sketches)
    members = store(connected_components(by_bands).select("node.key0", "node.key1", F.col("component.key0").alias("component")), "members")
    pairs = _crossing(sketches, members, similarity)
    met = store(_ends(pairs), "candidates")
    likely = _likely(pairs, _narrow(sketches, met), similarity)
    refs = store(_ends(likely), "candidates")
    sets = store(_sets(within(docs, key, refs), key, text_col, words, seed).select(_ref(), "shingles"), "shingles")
    by_prefix = store(_verified(likely, sets, similarity), "links")
    for table in (sketches, members, pairs, met, likely, refs, sets):
        drop(table)
    return by_bands.unionByName(by_prefix.select(F.col("lead").alias("a"), F.col("ref").alias("b")))


def _ref() -> Column:
    return F.struct("key0", "key1").alias("ref")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select("ref").union(pairs.select("lead")).distinct().select("ref.key0", "ref.key1")


def _narrow(sketches: DataFrame, refs: DataFrame) -> DataFrame:
    """(ref, size, classes) of the rows ``refs`` (stored)."""
    return within(sketches, [F.col("key0"), F.col("key1")], refs).select(_ref(), "size", "classes")


def _likely(pairs: DataFrame, parities: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` that sizes and parities by ``_classes`` don't exclude, stored: only these need their sets."""
    lead = parities.select(F.col("ref").alias("lead"), F.col("size").alias("other_size"), F.col("classes").alias("others"))
    both = pairs.join(parities, "ref").join(lead, "lead")
    small, large = F.least("size", "other_size"), F.greatest("size", "other_size")
    sized = both.where(small >= F.lit(similarity) * large - _SLACK)
    most = F.lit(1 - similarity) * (F.col("size") + F.col("other_size")) + _SLACK
    return store(sized.where(_apart("classes", "others") * (1 + similarity) <= most).select("ref", "lead"), "likely")


def _apart(one: str, two: str) -> Column:
    """Bits in which two rows of parities differ; of twice as many classes, the halves are folded; beyond, zero, as if they were equal."""
    a, b = F.col(one), F.col(two)
    xor = lambda x, y: F.zip_with(x, y, lambda i, j: i.bitwiseXOR(j))
    halves = lambda x: xor(F.slice(x, F.lit(1), (F.size(x) / 2).cast("int")), F.slice(x, (F.size(x) / 2).cast("int") + 1, F.size(x)))
    count = lambda x: F.aggregate(x, F.lit(0), lambda n, i: n + F.bit_count(i))
    same, wider, narrower = F.size(a) == F.size(b), F.size(a) == 2 * F.size(b), 2 * F.size(a) == F.size(b)
    return F.when(same, count(xor(a, b))).when(wider, count(xor(halves(a), b))).when(narrower, count(xor(a, halves(b)))).otherwise(0)


def _band_links(docs: DataFrame, key: list[Column], text_col: str, words: int, seed: int, similarity: float, sketches: DataFrame) -> DataFrame:
    """(a, b): links of rows with their bands' leaders."""
    hits = sketches.select(_ref(), F.explode("bands").alias("band"))
    shared = store(hits.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    hits = store(told(hits, shared, "band", "n"), "hits")
    drop(shared)
    refs = store(hits.select("ref").distinct().select("ref.key0", "ref.key1"), "candidates")
    parities = store(_narrow(sketches, refs), "parities")
    sets = store(_sets(within(docs, key, refs), key, text_col, words, seed), "shingles")
    found = []
    while True:
        weight = hits.groupBy("ref").agg(F.sum("n").alias("weight"), F.collect_list("band").alias("bands"))
        each = weight.select("ref", "weight", F.explode("bands").alias("band"))
        leaders = each.groupBy("band").agg(F.max(F.struct("weight", "ref")).alias("top"), F.count("*").alias("n"))
        leaders = store(leaders.select("band", F.col("top.ref").alias("lead"), "n"), "leaders")
        rest = store(told(hits, leaders, "band", "lead").where("ref <> lead"), "rest")
        likely = _likely(rest.select("ref", "lead").distinct(), parities, similarity)
        ends = store(_ends(likely), "ends")
        few = within(sets, [F.col("key0"), F.col("key1")], ends).select(_ref(), "shingles")
        links = store(_verified(likely, few, similarity), "links")
        for table in (hits, leaders, likely, ends):
            drop(table)
        found.append(links)
        if len(found) == ROUNDS or links.isEmpty():
            break
        hits = store(rest.join(links, ["ref", "lead"], "left_anti").select("band", "ref", "n"), "hits")
        drop(rest)
    for table in (rest, sets, refs, parities):
        drop(table)
    out = found[0]
    for links in found[1:]:
        out = out.unionByName(links)
    return out.select(F.col("lead").alias("a"), F.col("ref").alias("b"))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The (ref, lead) of ``pairs`` that reach ``similarity``; a leader's many rows are split by adaptive execution."""
    lead = sets.select(F.col("ref").alias("lead"), F.col("shingles").alias("others"))
    both = pairs.join(sets, "ref").join(lead, "lead")
    common = F.size(F.array_intersect("shingles", "others"))
    sized = both.select("ref", "lead", common.alias("common"), (F.size("shingles") + F.size("others")).alias("total"))
    return sized.where(F.col("common") / (F.col("total") - F.col("common")) >= similarity).select("ref", "lead")


def _crossing(sketches: DataFrame, members: DataFrame, similarity: float) -> DataFrame:
    """(lead, ref), each pair once, stored: rows of different components that share a shingle of their prefixes and may reach ``similarity``.

    Only shingles that cross components are kept; an aggregate finds them, so that no component's rows meet.
    """
    known = F.broadcast(members) if members.count() <= BROADCAST_KEYS else members.hint("merge")
    rows = sketches.join(known, ["key0", "key1"], "left").withColumn("component", F.coalesce("component", "key0"))
    held = rows.select("component", F.explode("prefix").alias("shingle"))
    crossed = held.groupBy("shingle").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("n")).where("a < b")
    crossed = store(crossed.select("shingle", "n"), "crossed")
    posts = sketches.select("key0", "key1", F.explode("prefix").alias("shingle"))
    if crossed.count() <= BROADCAST_KEYS:
        hits = posts.join(F.broadcast(crossed), "shingle")
    else:
        hits = told(posts, crossed, "shingle", "n")
    hits = hits.join(rows.select("key0", "key1", "component", "size", "bits"), ["key0", "key1"])
    parts = F.ceil(F.col("n") / MEET).cast("int")
    hits = hits.withColumn("block", F.pmod("key1", parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    hits = hits.select("shingle", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "component", "key0", "key1", "size", "bits")
    cells = hits.repartition("shingle", "lo", "hi").sortWithinPartitions("shingle", "lo", "hi")
    pairs = cells.mapInArrow(lambda batches: _meet(batches, similarity), "lead0 long, lead1 long, ref0 long, ref1 long").distinct()
    side = lambda n: F.struct(F.col(f"{n}0").alias("key0"), F.col(f"{n}1").alias("key1")).alias(n)
    pairs = store(pairs.select(side("lead"), side("ref")), "pairs")
    drop(crossed)
    return pairs


def _meet(batches, similarity: float):
    """The pairs of the cells of sorted rows that components, sizes and parity bitmaps don't exclude."""
    held = None
    for batch in chain(batches, [None]):
        if batch is not None:
            now = [c.to_numpy() for c in batch.columns[:-1]]
            now.append(np.frombuffer(b"".join(batch.columns[-1].to_pylist()), np.uint64).reshape(-1, BITS // 64))
            held = now if held is None else [np.concatenate(p) for p in zip(held, now, strict=True)]
        if held is None or not len(held[0]):
            continue
        starts = np.flatnonzero(np.concatenate(([True], np.any([c[1:] != c[:-1] for c in held[:3]], axis=0))))
        full = starts[-1] if batch is not None else len(held[0])  # the last cell may go on
        ends = np.append(starts[1:], len(held[0]))
        mates = (np.repeat(ends, ends - starts) - np.arange(len(held[0])) - 1)[:full]
        upto = np.concatenate(([0], np.cumsum(mates)))
        _, lo, hi, block, component, key0, key1, size, bits = held
        at = 0
        while at < full:
            to = max(at + 1, int(np.searchsorted(upto, upto[at] + (1 << 13), "right")) - 1)
            a = np.repeat(np.arange(at, to), mates[at:to])
            b = a + 1 + np.arange(len(a)) - np.repeat(upto[at:to] - upto[at], mates[at:to])
            at = to
            may = (component[a] != component[b]) & ((lo[a] == hi[a]) | (block[a] != block[b]))
            may &= np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]) - _SLACK
            a, b = a[may], b[may]
            apart = np.bitwise_count(bits[a] ^ bits[b]).sum(1, dtype=np.int64)
            may = apart * (1 + similarity) <= (1 - similarity) * (size[a] + size[b]) + _SLACK
            a, b = a[may], b[may]
            swap = (key0[a] > key0[b]) | ((key0[a] == key0[b]) & (key1[a] > key1[b]))
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key0[a], key1[a], key0[b], key1[b])], names=["lead0", "lead1", "ref0", "ref1"])
        held = [c[full:] for c in held]
