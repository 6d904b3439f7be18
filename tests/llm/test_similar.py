"""Links by the overlap of five-word shingles, held to all pairs of small tables."""

import itertools

import numpy as np
from textloom.llm import simhash, similar
from textloom.llm.common import row_digest
from test_quality import prose

COLUMNS = "doc_id long, text string, source string, ref int, band string, lead int, key0 long, bands string"


def shingles(text, words=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def groups(texts, share=0.8):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and both / len(sets[i] | sets[j]) >= share:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def changed(text, *at):
    return " ".join(f"other{i}" if i in at else w for i, w in enumerate(text.split()))


def table(spark, rows):
    return spark.createDataFrame([(d, t, "s", 1, "b", 2, 3, "x") for d, t in rows], COLUMNS).repartition(3)


def linked_groups(spark, rows):
    """The rows' groups, by links; compared as sets of texts."""
    df = table(spark, rows)
    named = df.select("text", *[k.alias(f"key{i}") for i, k in enumerate(row_digest(df))]).collect()
    text = {(r.key0, r.key1): r.text for r in named}
    return {(text[tuple(r.a)], text[tuple(r.b)]) for r in similar.similar_links(df, row_digest(df)).collect()}


BASE = prose(11, 60)
#: A text and 120 copies with a word changed: each is near the text (51 of 61), hardly one near another copy.
STAR = [BASE] + [changed(BASE, 5 + i % 50) + (f" tail{i}" if i >= 50 else "") for i in range(120)]
EDGE = " ".join(f"w{i}" for i in range(22))  # 18 shingles; with two words more at the end 18 of 20, with five 18 of 23


def test_links_reach_their_similarity(spark):
    texts = [EDGE, f"{EDGE} a b", f"{EDGE} a b c d e", "one two", "One  TWO", "one three", None, "", " \n ", "é É words here now too"]
    found = linked_groups(spark, list(enumerate(texts)))
    assert {frozenset(p) for p in found} == {frozenset((EDGE, f"{EDGE} a b")), frozenset((f"{EDGE} a b", f"{EDGE} a b c d e")), frozenset(("one two", "One  TWO"))}


def test_exactly_the_threshold(spark):
    short = " ".join(f"v{i}" for i in range(8))  # 4 shingles of 5
    assert {frozenset(p) for p in linked_groups(spark, [(1, short), (2, f"{short} end")])} == {frozenset((short, f"{short} end"))}
    assert linked_groups(spark, [(1, short), (2, f"{short} end more")]) == set()


def test_one_of_each_group_stays(spark):
    long = prose(12, 30_000)
    texts = STAR + [prose(k) for k in range(20, 40)] + [changed(prose(21), 8), prose(22).upper(), long, changed(long, 5, 900, 20_000), None, ""]
    rows = [(1000 - i if i % 7 else None, t) for i, t in enumerate(texts)] + [(3, BASE), (3, BASE)]
    df = table(spark, rows)
    out = simhash.drop_near_duplicates(df, similarity=0.8)
    assert out.columns == df.columns
    members = {}
    for row, g in zip(rows, groups([t or "" for _, t in rows])):
        members.setdefault(g if (row[1] or "").split() else "none", []).append(row)
    want = sorted(min((d is None, d or 0) for d, _ in g) for g in members.values())
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert sorted((d is None, d or 0) for d, _ in got) == want
    assert len({r for g in members.values() for r in got if r in g}) == len(got)
    again = simhash.drop_near_duplicates(df.repartition(5), similarity=0.8).collect()
    assert sorted(map(str, got)) == sorted(str((r.doc_id, r.text)) for r in again)


def test_without_rows_or_links(spark):
    assert similar.similar_links(table(spark, []), row_digest(table(spark, []))).count() == 0
    assert simhash.drop_near_duplicates(table(spark, []), similarity=0.8).count() == 0
    lone = table(spark, [(1, prose(1)), (None, prose(2)), (1, prose(3))])
    assert simhash.drop_near_duplicates(lone, similarity=0.8).count() == 3


def pair_that_no_band_tells(n):
    """``n`` pairs of texts at exactly 0.8 (4 of 5 shingles) whose min-hashes agree in no band."""
    draws, out = similar._draws(42), []
    for k in itertools.count():
        short = " ".join(f"m{k}x{i}" for i in range(8))
        one, two = (similar._band_keys(similar._shingles(t.encode(), 5, 42), draws) for t in (short, f"{short} end"))
        if not np.any(one == two):
            out += [short, f"{short} end"]
        if len(out) == 2 * n:
            return out


def test_links_that_no_band_tells(spark):
    texts = pair_that_no_band_tells(4)
    found = linked_groups(spark, list(enumerate(texts + [prose(k) for k in range(5)])))
    assert {frozenset(p) for p in found} == {frozenset(texts[i : i + 2]) for i in range(0, 8, 2)}
    out = simhash.drop_near_duplicates(table(spark, list(enumerate(texts))), similarity=0.8).collect()
    assert sorted(r.doc_id for r in out) == [0, 2, 4, 6]


def held_to_all_pairs(spark, texts):
    df = table(spark, list(enumerate(texts)))
    named = df.select("doc_id", *[k.alias(f"key{i}") for i, k in enumerate(row_digest(df))]).collect()
    at = {(r.key0, r.key1): r.doc_id for r in named}
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in similar.similar_links(df, row_digest(df)).collect():
        i, j = at[tuple(r.a)], at[tuple(r.b)]
        assert len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(texts))] == groups(texts)


def crowd():
    """Texts near one text and each other by just more or less than 0.8, and windows over a long text, each linked to the next few only."""
    rng = np.random.default_rng(5)
    texts = [changed(BASE, *rng.choice(60, rng.integers(1, 4), replace=False).tolist()) + f" t{i}" * int(rng.integers(0, 2)) for i in range(120)]
    line = prose(31, 600).split()
    return texts + [" ".join(line[i : i + 60]) for i in range(0, 250, 5)] + [prose(k) for k in range(40, 60)]


def test_links_connect_what_all_pairs_connect(spark):
    held_to_all_pairs(spark, crowd())


def test_groups_in_blocks_and_any_order(spark, monkeypatch):
    monkeypatch.setattr(similar, "MEET", 16)
    monkeypatch.setattr(similar, "COUNTED", 0)
    monkeypatch.setattr(similar, "BROADCAST_KEYS", 0)
    held_to_all_pairs(spark, crowd())


def test_parities_never_tell_more_than_sets_differ(spark):
    rng = np.random.default_rng(3)
    sets, rows = [], []
    for n in (1, 2, 60, 64, 65, 100, 130, 900, 1100, 5000, 6200):
        one = rng.integers(0, 1 << 64, n, np.uint64)
        sets += [one, np.concatenate((one[n // 10 :], rng.integers(0, 1 << 64, n // 10 + 1, np.uint64))), rng.integers(0, 1 << 64, n, np.uint64)]
    for a, b in itertools.combinations(sets, 2):
        rows.append((similar._classes(a).tolist(), similar._classes(b).tolist(), len(set(a.tolist()) ^ set(b.tolist())), len(a) + len(b)))
    df = spark.createDataFrame(rows, "one array<long>, two array<long>, differ long, total long")
    got = df.select(similar._apart("one", "two").alias("apart"), "differ", "total", (similar.F.size("one") / similar.F.size("two")).alias("ratio")).collect()
    assert all(r.apart <= r.differ and (r.differ - r.apart) % 2 == 0 for r in got if 0.5 <= r.ratio <= 2)
    assert all(r.apart * 1.8 > 0.2 * r.total for r in got if 0.5 <= r.ratio <= 2 and r.differ == r.total)


def test_large_texts_that_share_a_passage_need_no_sets(spark, monkeypatch):
    made = {}

    def counted(df, name, store=similar.store):
        out = store(df, name)
        made.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(similar, "COUNTED", 0)
    monkeypatch.setattr(similar, "store", counted)
    passage = " ".join(f"p{i}" for i in range(80))
    texts = [f"{passage} " + " ".join(f"t{k}w{i}" for i in range(4000 + 50 * k)) for k in range(8)]
    texts += [f"{passage} {EDGE}", texts[0] + " one more end"]
    assert {frozenset(p) for p in linked_groups(spark, list(enumerate(texts)))} == {frozenset((texts[0], texts[-1]))}
    assert sum(made["pairs"]) > 8  # they do meet in the index
    assert made["shingles"][-1] == 0  # and none is compared on whole sets there
