"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most r bits have a common variant within r/2 bits of each.
Every distinct fingerprint emits its ball of that radius, variants are the shuffle key, and
colliding fingerprints are verified. For r = 2 a variant's group holds at most the 65 distinct
fingerprints within one bit of it, whatever the corpus; copies of a text were collapsed before.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, drop, quoted, row_digest, store, told, within, without
from .similar import similar_links

_SHIFTS = np.arange(64, dtype=np.uint64)
#: Bound on the classes of equal fingerprints, and on the components, that are told by broadcast: those of more than this part of all rows.
HOT_CLASSES = 10_000


def _fingerprint(text: bytes, words: int, seed: int) -> int:
    import xxhash

    tokens = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(tokens) - words + 1].tolist()
    stops = (ends[words - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops)], dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += _column_sums(bits)
    return int(np.bitwise_or.reduce(np.where(2 * ones > len(hashes), np.uint64(1) << _SHIFTS, np.uint64(0))))


def _column_sums(bits: np.ndarray) -> np.ndarray:
    """Sums of (n, 64) zeros and ones: 255 rows fit a byte lane, so eight lanes are added at once."""
    n = len(bits)
    lanes = np.ascontiguousarray(bits).view(np.uint64)
    cuts = np.arange(0, n, 255)
    return np.add.reduceat(lanes, cuts, axis=0).view(np.uint8).reshape(len(cuts), 64).sum(0, dtype=np.int64)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42, carry: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, ``carry``, fp): 64-bit SimHash of each whole text's word shingles, repeats included.

    A text of fewer words is one shingle; null and wordless texts have fingerprint zero.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), *[c.alias(n) for n, c in (carry or {}).items()], F.col(text_col).cast("string").alias("text"))
    schema = own.drop("text").schema.add("fp", "long", False)

    def run(batches):
        for b in batches:
            fps = [0 if not t.is_valid else _fingerprint(t.as_buffer().to_pybytes(), words, seed) for t in b.columns[-1]]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.array(fps, np.uint64).view(np.int64))], names=schema.names)

    return own.mapInArrow(run, schema)


def ball_masks(radius: int) -> list[int]:
    """Bit masks of all variants within ``radius`` flips, as signed longs, zero first."""
    out = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(64), r)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in out]


def ball_links(fps: DataFrame, *, radius: int = 2) -> DataFrame:
    """Links (a, b) among the distinct values of ``fps.fp`` that connect all pairs within ``radius`` bits.

    Groups are joined by their smallest member where all of a group lies within ``radius`` of it
    (always, for an even radius: two members are within half of it of the variant); no group
    emits all its pairs. An odd radius is rounded up for the balls and verified.
    """
    if radius < 0:
        raise ValueError("radius must not be negative")
    half = (radius + 1) // 2
    masks = F.array(*[F.lit(m) for m in ball_masks(half)])
    hits = fps.select("fp", F.explode(masks).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("variant"))
    if radius == 2 * half:  # a sort by two longs; no sets are built
        links = hits.select(F.min("fp").over(Window.partitionBy("variant")).alias("a"), F.col("fp").alias("b"))
    else:  # at most the ball's size squared, a constant
        groups = hits.groupBy("variant").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
        links = groups.select(F.explode("fps").alias("a"), "fps").select("a", F.explode("fps").alias("b"))
    return links.where("a < b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct()


def fp_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    component_id is the smallest doc_id reachable over links of at most ``radius`` bits. Rows of
    equal fingerprint are collapsed to their smallest id first; only distinct fingerprints make
    variants. Very long texts are read whole. Null and empty texts share fingerprint zero and are
    linked like any other. Rows with a null id get the component of the other rows that they
    reach, null if there is none; repeated rows are kept. Extra columns, whatever their names, are
    ignored; an empty table gives no rows.
    """
    fps = store(fingerprints(docs, id_col=id_col, text_col=text_col, words=words, seed=seed), "fingerprints")
    classes = store(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "classes")
    linked = store(_linked(classes, radius), "linked")
    # Only linked fingerprints take part in the joins; the smallest id of a component is an aggregate.
    members = classes.join(linked, "fp").select("fp", "component", "first_id")
    least = store(members.groupBy("component").agg(F.min("first_id").alias("least_id"), F.count("*").alias("n")), "least")
    named = told(members, least, "component", "least_id", HOT_CLASSES).select("fp", "least_id")
    table = classes.join(named, "fp", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id"), "n")
    return told(fps, store(table, "classes"), "fp", "component_id", HOT_CLASSES).select("doc_id", fp_hex(F.col("fp")).alias("fingerprint"), "component_id")


def _linked(classes: DataFrame, radius: int) -> DataFrame:
    """(fp, component) of the fingerprints that have a link."""
    return connected_components(ball_links(classes.select("fp"), radius=radius)).select(F.col("node").alias("fp"), "component")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2, seed: int = 42, similarity: float | None = None) -> DataFrame:
    """``docs`` with one row for each group of near-duplicates, same columns: the one of the smallest id.

    Rows without an id come after those with one. Where several rows of a group have the smallest
    id, that of the smallest digest of all its columns stays; of rows equal in all columns, one.
    Rows are told apart by that digest, not by their ids. With a ``similarity``, the rows that the
    balls leave are also linked where their five-word shingles overlap by that share (``similar``),
    and again one of a group stays.
    """
    key = dict(zip(("key0", "key1"), row_digest(docs), strict=True))
    made = fingerprints(docs, id_col=id_col, text_col=text_col, words=words, seed=seed, carry=key)
    rows = store(made.groupBy("fp", "doc_id", "key0", "key1").agg(F.count("*").alias("n")), "fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key0", "key1")
    first = store(rows.groupBy("fp").agg(F.min(place).alias("place")), "classes")
    linked = store(_linked(first, radius), "linked")
    # One row a fingerprint; of linked ones, only that of the smallest place in the component.
    chained = first.join(linked, "fp").groupBy("component").agg(F.min(F.struct("place", "fp")).alias("best")).select("best.fp")
    losers = linked.join(chained, "fp", "left_anti").select("fp", F.lit(True).alias("loses"))
    stays = first.join(losers, "fp", "left").where("loses is null").select("place.key0", "place.key1")
    gone = store(rows.select("key0", "key1").join(stays, ["key0", "key1"], "left_anti"), "dropped")
    out = without(docs, row_digest(docs), gone)
    twice = rows.where("n > 1").join(stays, ["key0", "key1"], "left_semi").select("key0", "key1")
    twice = store(twice, "twice")
    if not twice.isEmpty():
        row = F.struct(*[F.col(quoted(c)) for c in docs.columns])
        again = within(docs, row_digest(docs), twice).select(*[k.alias(f"key{i}") for i, k in enumerate(row_digest(docs))], row.alias("row"))
        one = again.groupBy("key0", "key1").agg(F.first("row").alias("row")).select("row.*")
        out = without(out, row_digest(docs), twice).unionByName(one)
    for table in (rows, first, linked):
        drop(table)
    return out if similarity is None else _drop_similar(out, id_col, text_col, similarity, seed)


def _drop_similar(docs: DataFrame, id_col: str, text_col: str, similarity: float, seed: int) -> DataFrame:
    """``docs`` (no two rows equal) with one row, that of the smallest place, of each group of similar texts."""
    links = similar_links(docs, row_digest(docs), text_col=text_col, similarity=similarity, seed=seed)
    members = store(connected_components(links).select("node.key0", "node.key1", "component"), "similar")
    keys = store(members.select("key0", "key1"), "members")
    ids = within(docs, row_digest(docs), keys)
    ids = ids.select(*[k.alias(f"key{i}") for i, k in enumerate(row_digest(docs))], F.col(quoted(id_col)).alias("doc_id"))
    placed = members.join(ids, ["key0", "key1"]).select("component", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key0", "key1").alias("place"))
    first = placed.groupBy("component").agg(F.min("place").alias("place")).select("place.key0", "place.key1")
    gone = store(keys.join(first, ["key0", "key1"], "left_anti"), "dropped")
    for table in (members, keys):
        drop(table)
    return without(docs, row_digest(docs), gone)
