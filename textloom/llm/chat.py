r"""Chat formatting by columnar byte assembly, and the reader that takes it apart again.

A turn is ``### role: text </turn>\n``. Inside roles and texts a backslash comes before each
backslash, ``###`` and ``</turn>``, and in roles before each colon, so that every string can be
read back. Batches are assembled as columns: segment lengths, cumulative offsets and scatter
indices are numpy arrays, and headers and contents are copied into one preallocated buffer that
Arrow slices into strings.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shuffle_partitions

OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"
#: A conversation is cut between turns into parts of about this many bytes; most have one part.
PART_BYTES = 4 << 20

_MARK = re.compile(r"\\(\\|###|</turn>|:)|(###|</turn>)")
_COLON = re.compile(r"\\(?:\\|###|</turn>|:)|(:)")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")


def escape(texts: pa.Array, role: bool = False) -> pa.Array:
    for mark in ("\\", "###", "</turn>", *([":"] if role else [])):
        texts = pc.replace_substring(texts, mark, "\\" + mark)
    return texts


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of a string array."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and len(texts) else np.zeros(0, np.uint8)
    if not len(texts):
        return np.zeros(1, np.int64), data
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer of all turns: (its bytes, each turn's end in it, in code points where each text starts, and its length).

    Code points count from the start of the buffer.
    """
    roles, texts = escape(roles, role=True), escape(texts)
    n = len(texts)
    fixed = [np.frombuffer(x.encode(), np.uint8) for x in (OPEN, MIDDLE, CLOSE)]
    (role_at, role_data), (text_at, text_data) = _bytes(roles), _bytes(texts)
    lengths = np.empty((n, 5), np.int64)
    lengths[:, 0], lengths[:, 2], lengths[:, 4] = map(len, fixed)
    lengths[:, 1], lengths[:, 3] = np.diff(role_at), np.diff(text_at)
    ends = np.cumsum(lengths.ravel()).reshape(n, 5)
    starts = ends - lengths
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for column, data in zip((0, 2, 4), fixed):
        out[starts[:, column, None] + np.arange(len(data))] = data
    for column, at, data in ((1, role_at, role_data), (3, text_at, text_data)):
        out[np.repeat(starts[:, column] - at[:-1], lengths[:, column]) + np.arange(len(data))] = data
    points = lengths.copy()
    points[:, 1], points[:, 3] = pc.utf8_length(roles).to_numpy(zero_copy_only=False), pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    at = (np.cumsum(points.ravel()).reshape(n, 5) - points)[:, 3]
    return out, ends[:, -1], at, points[:, 3]


PARTS = T.StructType(
    [
        T.StructField("part", T.LongType()),
        T.StructField("n_turns", T.LongType()),
        T.StructField("formatted", T.StringType()),
        T.StructField("loss_start", T.ArrayType(T.LongType())),
        T.StructField("loss_end", T.ArrayType(T.LongType())),
    ]
)


def format_conversations(
    turns: DataFrame,
    *,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    loss_roles: tuple[str, ...] = ("assistant",),
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Rows (conv_id, part, n_turns, formatted, loss_start, loss_end), each conversation's parts in order.

    Turns are ordered by ``turn_col``, nulls first, ties by role and text; null roles and texts
    are empty. Loss spans are code points of ``formatted`` that hold texts of ``loss_roles``,
    escapes included. Rows of a null id are one conversation. Repeated rows are repeated turns;
    extra columns are ignored; an empty table gives no rows. Turns stream through a sorted
    partition, so that a conversation of any length takes bounded memory, and only a
    conversation of more than ``part_bytes`` has a second part.
    """
    spark = turns.sparkSession
    slim = turns.select(
        F.col(id_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    dealt = slim.repartition(shuffle_partitions(spark), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")
    schema = T.StructType([dealt.schema["conv_id"], *PARTS.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # turns of the last conversation so far
        part = 0  # its next part

        def emit(rows: pa.Table) -> pa.RecordBatch:
            nonlocal part
            rows = rows.combine_chunks()
            roles, texts = (rows[c].combine_chunks() for c in ("role", "text"))
            roles, texts = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (roles, texts))
            data, ends, at, points = assemble(roles, texts)
            ids = rows["conv_id"].to_pylist()
            firsts = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1])]
            stops = np.array([*firsts[1:], len(ids)])
            offsets = np.concatenate(([0], ends[stops - 1]))
            formatted = pa.LargeStringArray.from_buffers(len(firsts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))
            widths = pc.utf8_length(formatted).to_numpy()
            base = np.cumsum(widths) - widths
            scored = np.isin(np.array(roles.to_pylist(), object), list(loss_roles))
            spans = [(at[a:b][scored[a:b]] - base[i], points[a:b][scored[a:b]]) for i, (a, b) in enumerate(zip(firsts, stops.tolist()))]
            numbers = np.zeros(len(firsts), np.int64)
            numbers[0] = part
            part = int(numbers[-1]) + 1
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[i] for i in firsts], rows.schema.field("conv_id").type),
                    pa.array(numbers),
                    pa.array((stops - np.array(firsts)).astype(np.int64)),
                    formatted.cast(pa.string()),
                    pa.array([s.tolist() for s, _ in spans], pa.list_(pa.int64())),
                    pa.array([(s + n).tolist() for s, n in spans], pa.list_(pa.int64())),
                ],
                names=schema.names,
            )

        for b in batches:
            if not b.num_rows:
                continue
            now = pa.Table.from_batches([b])
            if held is not None:
                same = held["conv_id"][-1].as_py() == now["conv_id"][0].as_py()
                if not same:
                    yield emit(held)
                    part, held = 0, None
                else:
                    now, held = pa.concat_tables([held, now]), None
            # Slices of about part_bytes; the last conversation of each is carried on.
            sizes = np.cumsum(pc.binary_length(now["text"]).to_numpy() + 64)
            ids = now["conv_id"].to_pylist()
            begin = 0
            while begin < len(ids):
                done = int(sizes[begin - 1]) if begin else 0
                stop = max(begin + 1, int(np.searchsorted(sizes, done + part_bytes, side="right")))
                if stop >= len(ids):
                    break
                cut = stop
                while cut > begin and ids[cut - 1] == ids[stop]:
                    cut -= 1
                cut = cut if cut > begin else stop  # one conversation fills the slice: it gets another part
                yield emit(now.slice(begin, cut - begin))
                part = part if ids[cut] == ids[cut - 1] else 0
                begin = cut
            rest = now.slice(begin)
            first = len(ids)
            while first > begin and ids[first - 1] == ids[-1]:
                first -= 1
            if first > begin:
                yield emit(now.slice(begin, first - begin))
                part = 0
                rest = now.slice(first)
            held = rest
        if held is not None and held.num_rows:
            yield emit(held)

    return dealt.mapInArrow(run, schema)


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted part, unescaped."""
    at = 0
    begin = None
    for m in _MARK.finditer(formatted):
        if m[2] is None:
            continue
        if m[2] == "###" and begin is None and m.start() == at:
            begin = m.start() + len(OPEN)
        elif m[2] == "</turn>" and begin is not None:
            head = next(c for c in _COLON.finditer(formatted, begin) if c[1])
            yield unescape(formatted[begin : head.start()]), unescape(formatted[head.start() + len(MIDDLE) : m.start() - 1])
            at, begin = m.end() + 1, None
        else:
            raise ValueError(f"a control string where none may be, at {m.start()}")
    if begin is not None or at != len(formatted):
        raise ValueError("an unfinished turn")


DIGESTS = T.StructType(
    [
        T.StructField("n_turns", T.LongType()),
        T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()),
        T.StructField("formatted_chars", T.LongType()),
    ]
)


def read_back(parts: DataFrame) -> DataFrame:
    """Digests of what ``format_conversations`` gave, parsed from its strings, one row per conversation.

    Must follow it directly: parts of a conversation come one after another, in order.
    """
    schema = T.StructType([parts.schema["conv_id"], *DIGESTS.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None  # [conv_id, turns, hash, loss characters, loss hash, characters]

        def out(rows):
            columns = zip(*((i, n, h.hexdigest(), c, lh.hexdigest(), f) for i, n, h, c, lh, f in rows)) if rows else [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=schema.names)

        for b in batches:
            kinds = [b.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            done = []
            for row in b.to_pylist():
                if row["part"] == 0:
                    if now is not None:
                        done.append(now)
                    now = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = row["formatted"]
                for role, said in read_turns(text):
                    now[1] += 1
                    now[2].update(f"{role}\n{said}\n".encode())
                for a, e in zip(row["loss_start"], row["loss_end"]):
                    said = unescape(text[a:e])
                    now[3] += len(said)
                    now[4].update(said.encode())
                now[5] += len(text)
            yield out(done)
        if now is not None:
            yield out([now])

    return parts.mapInArrow(run, schema)


def digests(turns: DataFrame, **options) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of every conversation."""
    return read_back(format_conversations(turns, **options))
