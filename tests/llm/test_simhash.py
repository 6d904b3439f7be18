import re

import pytest
import xxhash

from textloom.llm import common, simhash


def brute_fp(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, radius=2):
    fps = [brute_fp(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, f"{fps[i]:016x}", min(ids, default=None)))
    return sorted(out, key=str)


BASE = "The quick brown fox jumps over the lazy dog and runs far away from here"
ROWS = (
    [(10, BASE), (3, BASE.upper()), (7, BASE + " x"), (None, BASE), (4, None), (9, ""), (6, " \n\t "), (1, "one"), (2, "one two")]
    + [(5, "été ÉTÉ naïve word\x0bnext"), (20, "z" * 5000), (21, "a b c " * 3000), (22, "a b c " * 3001), (3, BASE), (None, "lonely text here")]
    + [(100 + i, " ".join(f"w{j}" if j != i else f"changed{i}" for j in range(400))) for i in range(30)]
)


def test_matches_brute_force(spark):
    df = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(ROWS)], "doc_id long, text string, fp int").repartition(3)
    got = sorted(map(tuple, simhash.near_duplicates(df).collect()), key=str)
    assert got == brute(ROWS)


def test_large_classes_are_told_alike(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_CLASSES", 1)
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert sorted(map(tuple, simhash.near_duplicates(df).collect()), key=str) == brute(ROWS)


def test_driver_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert sorted(map(tuple, simhash.near_duplicates(df).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("radius", [0, 1, 3])
def test_other_radii(spark, radius):
    rows = ROWS[-30:]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, simhash.near_duplicates(df, radius=radius).collect()), key=str) == brute(rows, radius)


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_drop_keeps_one_of_each_group(spark):
    df = spark.createDataFrame([(*r, "s") for r in ROWS], "doc_id long, text string, source string")
    out = simhash.drop_near_duplicates(df)
    assert out.columns == df.columns
    found = brute(ROWS)
    ids = [r.doc_id for r in out.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for _, _, c in found if c is not None})
    assert ids.count(None) == len({fp for _, fp, c in found if c is None})


def test_ids_are_dropped_alike_by_both_joins(spark, monkeypatch):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    few = sorted(map(str, simhash.drop_near_duplicates(df).collect()))
    monkeypatch.setattr(common, "BROADCAST_KEYS", 0)
    assert sorted(map(str, simhash.drop_near_duplicates(df).collect())) == few
