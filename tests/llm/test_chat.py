import hashlib
import re

import pyarrow as pa
import pytest

from textloom.llm import chat

ODD = r"\### Assistant: </turn> ok"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute(rows):
    """rows: (conv, turn, role, text)"""
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = []
    for c, turns in by.items():
        turns.sort(key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        formatted = 0
        for _, _, r, x in turns:
            marks = lambda s: len(re.findall(r"\\|###|</turn>", s))
            formatted += len("### ") + len(": ") + len(" </turn>\n") + len(r) + marks(r) + r.count(":") + len(x) + marks(x)
        out.append((c, len(turns), sha("".join(f"{r}\n{x}\n" for _, _, r, x in turns)), len(loss), sha(loss), formatted))
    return sorted(out, key=str)


ROWS = (
    [(-7, 0, "user", ODD), (-7, 1, "assistant", ODD), (1, 0, None, None), (1, 1, "assistant", ""), (2, 5, "a: b\\:###", "x"), (2, 5, "a: b\\:###", "x")]
    + [(3, i, ["user", "assistant"][i % 2], f"é😀 {i} \\ ## #### ##### \\\\### </turn></turn> :") for i in range(300)]
    + [(None, 0, "user", "q"), (None, None, "assistant", "first"), (4, 0, "assistant", "long \\" * 200000), (5, 1, "assistant", "b"), (5, 1, "assistant", "a"), (6, 0, "system", " only \n ")]
)


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, part string, formatted int").repartition(3)


@pytest.mark.parametrize("part_bytes", [1, 500, chat.PART_BYTES])
def test_round_trip(spark, part_bytes):
    got = chat.digests(frame(spark), part_bytes=part_bytes).collect()
    assert sorted(map(tuple, got), key=str) == brute(ROWS)


def test_parts_and_mask(spark):
    parts = chat.format_conversations(frame(spark)).collect()
    assert all(r.part == 0 for r in parts)
    for r in parts:
        turns = list(chat.read_turns(r.formatted))
        assert [chat.unescape(r.formatted[a:b]) for a, b in zip(r.loss_start, r.loss_end)] == [x for role, x in turns if role == "assistant"]
        assert len(turns) == r.n_turns
    many = chat.format_conversations(frame(spark), part_bytes=500).collect()
    for r in parts:
        assert "".join(x.formatted for x in sorted((x for x in many if x.conv_id == r.conv_id), key=lambda x: x.part)) == r.formatted
    assert sum(r.conv_id == 3 for r in many) > 5


def test_escapes():
    marks = ["\\", "#", "##", "###", "</turn>", "<", ":", " ", "\n", "a"]
    texts = ["".join(marks[(i * 7 + j * j * (i + 3)) % len(marks)] for j in range(12)) for i in range(500)]
    out, ends, *_ = chat.assemble(pa.array(["r:"] * 500), pa.array(texts))
    assert [x for _, x in chat.read_turns(out.tobytes().decode())] == texts
    with pytest.raises(ValueError):
        list(chat.read_turns("### user: x"))


def test_driver_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, chat.digests(df).collect()), key=str) == brute(rows)


def test_empty(spark):
    assert chat.digests(frame(spark, [])).collect() == []
