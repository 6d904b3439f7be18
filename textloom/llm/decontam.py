"""Benchmark decontamination by a distributed positional inverted index.

The index is split by documents, as large search engines split theirs: a segment holds the
postings (term, positions) of a bounded run of documents, so that no term's list, however
common, meets in one place, and a query runs on every segment by itself. A window of test words
is looked up from its rarest term in the segment: the lists of the other terms, each shifted by
the term's offset in the window, are intersected one after another, shortest first.

Test items of any size are asked for in parts that fit into a task; what the parts find in a
document is put together. Items of one part ask a segment as soon as it is built, in the same
task, and it goes; for more parts the index is stored, in row groups of a bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import digest, drop, store, without

#: Bytes of text that a segment gathers before it is closed; a longer document is a segment of its own.
SEGMENT_BYTES = 2 << 20
#: Bytes of test items that are sent to every task at a time, in expectation; a longer item goes alone with others.
PART_BYTES = 8 << 20
#: Bytes of a row group of a stored index, which its writer and its reader hold whole; sizes are checked at every row.
GROUP_BYTES = 8 << 20
#: Maps A-Z to lower case and all ASCII but letters and digits to a space.
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased ASCII letters and digits and all other characters beyond ASCII, in runs."""
    return text.translate(_KEEP).split()


def _index_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("segment", T.StringType()),
            T.StructField("doc_id", T.ArrayType(id_type)),
            T.StructField("n_words", T.ArrayType(T.LongType())),
            T.StructField("term", T.ArrayType(T.BinaryType())),
            T.StructField("n_postings", T.ArrayType(T.IntegerType())),
            T.StructField("postings", T.BinaryType()),
        ]
    )


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Positional postings of all words of whole texts, one row per segment; it answers any later query.

    A segment's documents follow one another on one axis of positions, with a gap of one between
    two; ``postings`` holds each term's ascending positions on it as 32-bit integers, ``n_postings``
    how many belong to each term. Null and empty texts have no postings but keep their place. Ids
    may be of any type.
    """
    slim = _slim(docs, id_col, text_col)
    schema = _index_schema(slim.schema[0].dataType)
    names = schema.names
    return slim.mapInArrow(lambda batches: _segments(batches, names, segment_bytes), schema)


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _segments(batches: Iterator[pa.RecordBatch], names: list[str], segment_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows of the index, one a batch, of a task's (doc_id, text); holds one segment at a time."""
    ids, counts, base, made = [], [], 0, 0
    number: dict[bytes, int] = {}
    parts: list[np.ndarray] = []
    kind = None

    def close() -> pa.RecordBatch:
        nonlocal ids, counts, base, made, number, parts
        term = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        position = np.flatnonzero(term >= 0).astype("<i4")
        term = term[position]
        order = np.argsort(term, kind="stable")
        row = [
            pa.array([f"{TaskContext.get().partitionId()}-{made}"]),
            pa.array([ids], pa.list_(kind)),
            pa.array([counts], pa.list_(pa.int64())),
            pa.array([list(number)], pa.list_(pa.binary())),
            pa.array([np.bincount(term, minlength=len(number)).astype(np.int32)], pa.list_(pa.int32())),
            pa.array([position[order].tobytes()], pa.binary()),
        ]
        ids, counts, base, made, number, parts = [], [], 0, made + 1, {}, []
        return pa.RecordBatch.from_arrays(row, names=names)

    for b in batches:
        kind = b.column(0).type
        for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
            tokens = words_of(text.as_buffer().to_pybytes()) if text.is_valid else []
            if ids and (base + len(tokens)) * 8 + len(ids) * 64 > segment_bytes:
                yield close()
            found = np.fromiter((number.setdefault(w, len(number)) for w in tokens), np.int32, len(tokens))
            parts += [found, _GAP]
            ids.append(doc)
            counts.append(len(tokens))
            base += len(tokens) + 1
    if ids:
        yield close()


_GAP = np.array([-1], np.int32)


class Windows:
    """Test items' windows as a matrix of term numbers, -1 beyond a short window's end.

    ``items`` are (id as a string or None, text). Windows lie in the order of their key, the term
    that is rarest among the items, so that a segment looks only at those whose key it holds.
    """

    def __init__(self, items: list[tuple[str | None, str | None]], width: int):
        self.term: dict[bytes, int] = {}
        rows: dict[tuple[int, ...], set] = {}
        for item, text in items:
            numbers = [self.term.setdefault(w, len(self.term)) for w in words_of((text or "").encode())]
            for i in range(max(1, len(numbers) - width + 1) if numbers else 0):
                rows.setdefault(tuple(numbers[i : i + width]), set()).add(item)
        matrix = np.full((len(rows), width), -1, np.int32)
        for i, row in enumerate(rows):
            matrix[i, : len(row)] = row
        often = np.append(np.bincount(matrix[matrix >= 0], minlength=len(self.term)), 1 << 60)
        key = matrix[np.arange(len(rows)), often[matrix].argmin(1)] if len(rows) else np.zeros(0, np.int32)
        order = np.argsort(key, kind="stable")
        listed = [sorted(x, key=lambda i: (i is None, i)) for x in rows.values()]
        self.items = [listed[i] for i in order.tolist()]
        self.matrix = matrix[order]
        self.length = (self.matrix >= 0).sum(1)
        self.terms = pa.array(list(self.term), pa.binary())
        self.first = np.searchsorted(key[order], np.arange(len(self.term) + 1))  # a key's windows


class Segment:
    """One row of the index, ready for look-ups by the term numbers of ``windows``."""

    def __init__(self, ids: list, n_words: np.ndarray, terms: pa.Array, n_postings: np.ndarray, postings: pa.Buffer, windows: Windows):
        self.ids, self.n_words, self.windows = ids, n_words, windows
        self.start = np.concatenate(([0], np.cumsum(self.n_words + 1)))
        position = np.frombuffer(postings, "<i4") if postings.size else np.zeros(0, "<i4")
        ends = np.cumsum(n_postings, dtype=np.int64)
        number = pc.index_in(terms, value_set=windows.terms).fill_null(-1).to_numpy(zero_copy_only=False)
        known = np.flatnonzero((number >= 0) & (n_postings > 0))
        self.at = {k: position[e - n : e] for k, n, e in zip(number[known].tolist(), n_postings[known].tolist(), ends[known].tolist())}
        self.df = np.zeros(len(windows.term) + 1, np.int64)  # the last one for -1
        self.df[number[known]] = n_postings[known]
        self.df[-1] = len(position) + 1

    def _candidates(self) -> np.ndarray:
        """Windows all of whose terms occur in the segment."""
        keys = np.fromiter(self.at, np.int64, len(self.at))
        first, end = self.windows.first[keys], self.windows.first[keys + 1]
        keys, first, end = keys[end > first], first[end > first], end[end > first]
        if not len(keys):
            return np.zeros(0, np.int64)
        some = np.concatenate([np.arange(a, e) for a, e in zip(first.tolist(), end.tolist())])
        return np.sort(some[(self.df[self.windows.matrix[some]] > 0).all(1)])

    def phrases(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(window, starts on the segment's axis, documents' numbers) of exact occurrences."""
        for w in self._candidates().tolist():
            row = self.windows.matrix[w]
            offsets = np.argsort(self.df[row], kind="stable").tolist()[: int(self.windows.length[w])]
            starts = self.at[int(row[offsets[0]])] - offsets[0]
            for k in offsets[1:]:
                other = self.at[int(row[k])]
                found = np.searchsorted(other, starts + k)
                found[found == len(other)] = 0
                starts = starts[other[found] == starts + k]
                if not len(starts):
                    break
            else:
                yield w, starts, np.searchsorted(self.start, starts, side="right") - 1

    def near(self, slop: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(window, starts, documents' numbers) where every term lies within ``slop`` words of where the phrase would have it.

        Places are told from the window's rarest term in the segment; they must be in one document.
        """
        for w in self._candidates().tolist():
            row = self.windows.matrix[w]
            offsets = np.argsort(self.df[row], kind="stable").tolist()[: int(self.windows.length[w])]
            anchor = offsets[0]
            place = self.at[int(row[anchor])]
            doc = np.searchsorted(self.start, place, side="right") - 1
            low, high = self.start[doc], self.start[doc + 1] - 2
            for k in offsets[1:]:
                other = self.at[int(row[k])]
                first = np.searchsorted(other, np.maximum(place + (k - anchor) - slop, low))
                ok = first < len(other)
                ok[ok] = other[first[ok]] <= np.minimum(place + (k - anchor) + slop, high)[ok]
                place, doc, low, high = place[ok], doc[ok], low[ok], high[ok]
                if not len(place):
                    break
            else:
                yield w, place - anchor, doc


def _ask(index: Iterator[pa.RecordBatch], windows: Windows, answer) -> Iterator[pa.RecordBatch]:
    for b in index:
        kind = b.schema.field("doc_id").type.value_type
        for i in range(b.num_rows):
            cell = {n: b.column(n)[i] for n in b.schema.names}
            n_words, n_postings = (cell[n].values.to_numpy(zero_copy_only=False) for n in ("n_words", "n_postings"))
            segment = Segment(cell["doc_id"].as_py(), n_words, cell["term"].values, n_postings, cell["postings"].as_buffer(), windows)
            columns = answer(segment, cell["segment"].as_py(), kind)
            yield pa.RecordBatch.from_pydict(columns)


def _query(index: DataFrame, windows: Windows, answer, schema: T.StructType) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast(windows)
    return index.mapInArrow(lambda batches: _ask(batches, shared.value, answer), schema)


def _query_built(docs: DataFrame, windows: Windows, answer, schema: T.StructType) -> DataFrame:
    """``_query`` of the index of ``docs`` (doc_id, text), whose segments go from hand to hand inside a task."""
    shared = docs.sparkSession.sparkContext.broadcast(windows)
    names = _index_schema(docs.schema[0].dataType).names
    return docs.mapInArrow(lambda batches: _ask(_segments(batches, names, SEGMENT_BYTES), shared.value, answer), schema)


def load_windows(items: DataFrame, *, item_col: str = "item_id", text_col: str = "text", width: int = 10, part_bytes: int = PART_BYTES) -> Iterator[Windows]:
    """The windows of all test items, in parts of about ``part_bytes`` of text that the driver holds one at a time."""
    own = items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    size = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    parts = max(1, math.ceil(size / part_bytes))
    for i in range(parts):
        some = own.where(F.pmod(F.xxhash64("text", "item"), F.lit(parts)) == i) if parts > 1 else own
        yield Windows([(r.item, r.text) for r in some.collect()], width)


def _id_type(index: DataFrame) -> T.DataType:
    return index.schema["doc_id"].dataType.elementType


def matches(index: DataFrame, windows: Windows, *, slop: int | None = None) -> DataFrame:
    """(doc_id, item_id, start, kind): where items' windows occur, as ``phrase`` or, with ``slop``, also ``near``.

    start counts words from 0; a near match's start is where its rarest term puts it. item_id is a string.
    """

    def answer(s: Segment, name: str, kind: pa.DataType) -> dict:
        out: dict = {"doc_id": [], "item_id": [], "start": [], "kind": []}
        exact = set()
        for how, found in (("phrase", s.phrases()), *((("near", s.near(slop)),) if slop is not None else ())):
            for w, places, docs in found:
                for d, p in zip(docs.tolist(), places.tolist()):
                    if how == "phrase":
                        exact.add((w, p))
                    elif (w, p) in exact:
                        continue
                    for item in s.windows.items[w]:
                        for k, v in zip(out, (s.ids[d], item, p - int(s.start[d]), how)):
                            out[k].append(v)
        return {"doc_id": pa.array(out["doc_id"], kind), "item_id": pa.array(out["item_id"], pa.string()), "start": pa.array(out["start"], pa.int64()), "kind": pa.array(out["kind"], pa.string())}

    return _query(index, windows, answer, T.StructType().add("doc_id", _id_type(index)).add("item_id", "string").add("start", "long").add("kind", "string"))


def overlaps(index: DataFrame, parts: Iterator[Windows]) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside any occurrence of a window), item_ids (sorted as strings)."""
    head = next(parts)
    second = next(parts, None)
    if second is None:
        return _query(index, head, *_whole_overlaps(_id_type(index)))
    found = store(_part_overlaps(index, head), "hits")
    hits = [found]
    while second is not None:
        hits.append(store(_part_overlaps(index, second), "hits"))
        second = next(parts, None)
    every = hits[0]
    for more in hits[1:]:
        every = every.unionByName(more)
    # A document's ranges are its own words at most; they are merged in order of their starts.
    joined = every.groupBy("segment", "doc").agg(F.array_sort(F.flatten(F.collect_list("ranges"))).alias("ranges"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    n = F.aggregate("ranges", start, lambda x, r: F.struct(F.greatest(x["end"], r["b"]).alias("end"), (x["n"] + F.greatest(r["b"] - F.greatest(x["end"], r["a"]), F.lit(0))).alias("n")), lambda x: x["n"])
    rows = index.select("segment", F.posexplode(F.arrays_zip("doc_id", "n_words")).alias("doc", "row")).select("segment", "doc", "row.doc_id", "row.n_words")
    counted = joined.select("segment", "doc", n.alias("n_hit"), "item_ids")
    none = F.array().cast("array<string>")
    return rows.join(counted, ["segment", "doc"], "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids"))


def _found(docs: DataFrame, parts: Iterator[Windows], id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """``overlaps`` of the index of ``docs``, and that index where it was stored."""
    head = next(parts)
    second = next(parts, None)
    if second is None:
        slim = _slim(docs, id_col, text_col)
        return _query_built(slim, head, *_whole_overlaps(slim.schema[0].dataType)), None
    grouped = {"parquet.block.size": GROUP_BYTES, "parquet.page.size.row.check.min": 1}
    index = store(build_index(docs, id_col=id_col, text_col=text_col), "index", **grouped)
    return overlaps(index, chain((head, second), parts)), index


def _covered(s: Segment) -> tuple[np.ndarray, dict[int, set]]:
    """Which places of the segment's axis lie inside an occurrence, and the items found in each document."""
    cover = np.zeros(int(s.start[-1]) + 1, np.int32)
    items: dict[int, set] = {}
    for w, starts, docs in s.phrases():
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + int(s.windows.length[w]), -1)
        for d in np.unique(docs).tolist():
            items.setdefault(d, set()).update(s.windows.items[w])
    return np.cumsum(cover)[:-1] > 0, items


def _named(items: set) -> list[str]:
    return sorted(i for i in items if i is not None)


def _whole_overlaps(id_type: T.DataType) -> tuple:
    """What a segment answers by all test items, and its schema."""

    def answer(s: Segment, name: str, kind: pa.DataType) -> dict:
        inside, items = _covered(s)
        hit = np.concatenate(([0], np.cumsum(inside)))
        n_hit = hit[s.start[1:] - 1] - hit[s.start[:-1]]
        named = [_named(items.get(d, set())) for d in range(len(s.ids))]
        return {"doc_id": pa.array(s.ids, kind), "n_words": pa.array(s.n_words), "n_hit": pa.array(n_hit.astype(np.int64)), "item_ids": pa.array(named, pa.list_(pa.string()))}

    return answer, T.StructType().add("doc_id", id_type).add("n_words", "long").add("n_hit", "long").add("item_ids", T.ArrayType(T.StringType()))


def _part_overlaps(index: DataFrame, windows: Windows) -> DataFrame:
    """(segment, doc, ranges of words, item_ids) of documents with an occurrence."""
    pair = pa.struct([("a", pa.int64()), ("b", pa.int64())])

    def answer(s: Segment, name: str, kind: pa.DataType) -> dict:
        inside, items = _covered(s)
        edge = np.diff(np.concatenate(([0], inside.astype(np.int8), [0])))
        a, b = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
        doc = np.searchsorted(s.start, a, side="right") - 1
        ranges: dict[int, list] = {}
        for d, x, y in zip(doc.tolist(), (a - s.start[doc]).tolist(), (b - s.start[doc]).tolist()):
            ranges.setdefault(d, []).append({"a": x, "b": y})
        return {
            "segment": pa.array([name] * len(ranges), pa.string()),
            "doc": pa.array(list(ranges), pa.int32()),
            "ranges": pa.array(list(ranges.values()), pa.list_(pair)),
            "item_ids": pa.array([_named(items[d]) for d in ranges], pa.list_(pa.string())),
        }

    return _query(index, windows, answer, T._parse_datatype_string("segment string, doc int, ranges array<struct<a:bigint,b:bigint>>, item_ids array<string>"))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 10,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is ``width`` consecutive words of an item; an item of fewer, but not none, is one
    window. Null and wordless texts have no words and no hits; null and wordless items no
    windows. Ids of either table may be of any type, null or repeated. Items without an id mark
    words but are not listed. Very long texts are a segment of their own, read whole; test items
    of any size are looked up in parts. Repeated rows of either table, ties and extra columns,
    whatever their names, change nothing; an empty table of documents gives no rows.
    """
    parts = load_windows(benchmark, item_col=item_col, text_col=item_text_col, width=width, part_bytes=part_bytes)
    return _found(docs, parts, id_col, text_col)[0].select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10, max_share: float = 0.0) -> DataFrame:
    """``docs`` without the rows whose share of hit words is above ``max_share``, same columns.

    Rows go by their text, on which alone their verdict depends, whatever their ids.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(F.struct(*[k.alias(f"key{i}") for i, k in enumerate(digest(text))]).alias("doc"), text.alias("text"))
    found, index = _found(slim, load_windows(benchmark, item_col=item_col, text_col=item_text_col, width=width), "doc", "text")
    hit = (F.col("n_hit") > 0) & (F.col("n_hit") > max_share * F.col("n_words"))
    bad = store(found.where(hit).select("doc_id.key0", "doc_id.key1").distinct(), "contaminated")
    if index is not None:
        drop(index)
    return without(docs, digest(text), bad)
