import hashlib
import re

from textloom.llm import decontam

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, width=10):
    windows = []
    for item, text in items:
        w = words(text)
        windows += [(item, w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, win in windows:
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(item)
        named = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
ITEMS = [(1, ITEM), (2, "Only-Three WORDS"), (10, "rare été 42x"), (3, None), (4, ""), (5, "..."), (None, "nameless item"), (2, "Only-Three WORDS"), (6, ("the of " * 8))]
DOCS = [
    (1, f"before {ITEM} after"),
    (2, ITEM.upper().replace(" ", ", ")),
    (3, "alpha beta gamma delta epsilon zeta eta theta iota"),
    (4, "x only three words only three words y"),
    (5, None),
    (6, ""),
    (7, " .,;\n"),
    (8, "Rare Été 42X rare ÉTÉ 42x"),
    (9, "the of " * 3000),
    (10, "only three"),
    (11, "words"),
    (None, "nameless item"),
    (2, ITEM),
    (12, f"{ITEM} " * 40),
    (13, "one of the the of the of the of the of the of"),
]


def frames(spark, docs=DOCS, items=ITEMS):
    return (
        spark.createDataFrame([(d, t, "en", i) for i, (d, t) in enumerate(docs)], "doc_id long, text string, word string, item_id int").repartition(2),
        spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string"),
    )


def test_matches_brute_force(spark):
    got = decontam.contamination(*frames(spark)).collect()
    assert sorted(map(tuple, got), key=str) == brute(DOCS, ITEMS)


def test_segments_change_nothing(spark):
    docs, _ = frames(spark)
    windows = decontam.Windows([(None if i is None else str(i), t) for i, t in ITEMS], 10)
    want = None
    for size in (1, 300, 1 << 30):
        got = sorted(map(str, decontam.overlaps(decontam.build_index(docs, segment_bytes=size), iter([windows])).collect()))
        want = want or got
        assert got == want


def test_parts_change_nothing(spark):
    """Test items that are looked up in several parts give what one part gives, overlapping windows included."""
    want = sorted(map(str, decontam.contamination(*frames(spark)).collect()))
    for size in (60, 200):
        assert sorted(map(str, decontam.contamination(*frames(spark), part_bytes=size).collect())) == want


def test_ids_of_any_type(spark):
    docs, items = frames(spark)
    named = lambda df, c: df.withColumn(c, df[c].cast("string"))
    plain = decontam.contamination(docs, items).collect()
    got = decontam.contamination(named(docs, "doc_id"), named(items, "item_id")).collect()
    assert sorted((str(r.doc_id), *r[1:]) for r in plain) == sorted((str(r.doc_id), *r[1:]) for r in got)
    assert got[0].doc_id is None or isinstance(got[0].doc_id, str)
    odd = decontam.contamination(docs.withColumn("doc_id", docs.text), items.withColumn("item_id", items.text))
    assert odd.count() == len(DOCS)


def test_driver_tables(spark):
    d = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "benchmark"))
    got = decontam.contamination(docs, items).collect()
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert sorted(map(tuple, got), key=str) == want
    assert any(r.contaminated for r in got)


def test_phrase_and_proximity(spark):
    docs, _ = frames(spark, [(1, "red green blue"), (2, "red very green deep blue"), (3, "blue green red"), (4, "red a b c d green blue"), (5, "green blue"), (6, "x red"), (7, "pad pad red x green blue")])
    windows = decontam.Windows([("9", "red green blue")], 10)
    got = decontam.matches(decontam.build_index(docs), windows, slop=2).collect()
    assert sorted((r.doc_id, r.kind) for r in got) == [(1, "phrase"), (2, "near"), (3, "near"), (7, "near")]
    assert [r.start for r in got if r.kind == "phrase"] == [0]
    assert [r.doc_id for r in decontam.matches(decontam.build_index(docs), windows).collect()] == [1]


def test_empty_and_columns(spark):
    docs, items = frames(spark, [], ITEMS)
    assert decontam.contamination(docs, items).collect() == []
    docs, items = frames(spark, DOCS, [])
    assert not any(r.contaminated for r in decontam.contamination(docs, items).collect())
    docs, items = frames(spark)
    kept = decontam.decontaminate(docs, items)
    assert kept.columns == docs.columns
    clean = [str(d) for d, t in DOCS if not brute([(d, t)], ITEMS)[0][5]]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(clean)


def test_index_is_not_held_in_large_row_groups(spark, monkeypatch):
    """One part of test items stores no index; a stored one has row groups of a few segments, however many a task makes."""
    import glob

    import pyarrow.parquet as pq

    kept = []
    store = decontam.store
    monkeypatch.setattr(decontam, "store", lambda df, name, **options: kept.append((name, store(df, name, **options))) or kept[-1][1])
    docs = spark.createDataFrame([(i, f"{ITEM} " + " ".join(f"w{(i * 31 + k) % 5000}x" for k in range(3000))) for i in range(60)], "doc_id long, text string").coalesce(1)
    _, items = frames(spark)
    whole = decontam.contamination(docs, items)
    assert not kept and whole.count() == 60
    monkeypatch.setattr(decontam, "SEGMENT_BYTES", 50_000)
    monkeypatch.setattr(decontam, "GROUP_BYTES", 200_000)
    monkeypatch.setattr(decontam.build_index, "__kwdefaults__", decontam.build_index.__kwdefaults__ | {"segment_bytes": 50_000})
    parted = decontam.contamination(docs, items, part_bytes=60)
    index = next(df for name, df in kept if name == "index")
    groups = [pq.ParquetFile(f).metadata.row_group(i) for f in glob.glob(index._stored_at.removeprefix("file:") + "/*.parquet") for i in range(pq.ParquetFile(f).num_row_groups)]
    assert index.count() == 30 and max(g.num_rows for g in groups) < 10 and max(g.total_byte_size for g in groups) < 400_000
    assert sorted(map(str, parted.collect())) == sorted(map(str, whole.collect()))
