from fractions import Fraction
import re

import numpy as np

from textloom.llm import mixing


def brute_targets(sizes, epochs=3):
    """Fill in steps: share what is left by weight, cap, repeat."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    goal = {s: Fraction(0) for s in order}
    left = Fraction(sum(sizes.values()))
    while left:
        open_ = [s for s in order if goal[s] < epochs * sizes[s]]
        if not open_:
            break
        share = left / sum(weight[s] for s in open_)
        left = Fraction(0)
        for s in open_:
            goal[s] += share * weight[s]
            if goal[s] > epochs * sizes[s]:
                left += goal[s] - epochs * sizes[s]
                goal[s] = Fraction(epochs * sizes[s])
    return {s: float(v) for s, v in goal.items()}


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string, copies int")


def rows_of(n=3000):
    out = []
    for i in range(n):
        source = None if i % 17 == 0 else ["hot", "b", "c", "É"][0 if i % 3 else i % 4]
        out.append((i, None if i % 50 == 0 else "w " * (i * 7919 % 97) if i % 500 else "long " * 5000, source, "x", 1))
    return out + [(1, "w w", "b", "x", 1)] * 5 + [(None, "w w w", "c", "x", 1)] * 2 + [(None, None, None, None, None)]


def test_targets():
    for sizes in ({"a": 10, "b": 0, "c": 90, None: 4}, {"a": 1, "b": 1}, {None: 5}, {}, {"x": 0}, {f"s{i}": i**3 for i in range(40)}):
        got, want = mixing.targets(sizes), brute_targets(sizes)
        assert got.keys() == want.keys()
        assert all(abs(got[s] - want[s]) < 1e-6 for s in got)


def test_mix(spark):
    rows = rows_of()
    df = table(spark, rows)
    got = mixing.mix(df).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted((d is None, d or 0, size(t)) for d, t, *_ in rows)
    sizes = {}
    for _, t, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = brute_targets(sizes)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 and r.taken == r.size * r.copies and r.taken <= 3 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= max(r.size for r in own) + 1e-6
    again = mixing.mix(df.repartition(7)).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_expectation(spark):
    """Over many seeds a document's mean number of copies is its source's rate."""
    df = table(spark, [(i, "w " * (1 + i % 7), "a" if i < 30 else "b", "", 0) for i in range(60)])
    total = {}
    for seed in range(10):
        for r in mixing.mix(df, seed=seed).collect():
            total[r.doc_id] = total.get(r.doc_id, 0) + r.copies
            rate = r.target / r.source_size
            assert r.copies in (int(rate), int(rate) + 1)
    mean = sum(total[i] for i in range(30)) / 30 / 10
    assert abs(mean - 2 / 3 * (sum(1 + i % 7 for i in range(60)) / 2) / sum(1 + i % 7 for i in range(30))) < 0.12
    assert len(set(total.values())) > 5


def test_pairing():
    """Each leaf keeps its words but for one fraction, and every document its expectation."""
    random = np.random.default_rng(1)
    n = 40
    leaf, words, share = np.arange(n) // 13, random.integers(1, 30, n).astype(float), random.random(n)
    share[:2] = 0, 1
    total = np.zeros(n)
    runs = 4000
    for k in range(runs):
        f = mixing.pivot(leaf, words, share, random.integers(-(1 << 63), 1 << 63, n, np.int64))
        for j in range(leaf.max() + 1):
            own = leaf == j
            assert ((f[own] > 0) & (f[own] < 1)).sum() <= 1 and abs((words * f)[own].sum() - (words * share)[own].sum()) < 1e-6
        total += f
    assert np.abs(total / runs - share).max() < 0.04
    assert mixing.pivot(leaf[:0], words[:0], share[:0], np.zeros(0, np.int64)).size == 0


def test_sources_beyond_the_drivers(spark, monkeypatch):
    df = table(spark, rows_of(500) + [(i, "w " * i, f"s{i % 40}", "", 0) for i in range(200)] + [(1, "", "none", "", 0)])
    key = lambda rs: sorted((str(r.doc_id), str(r.source), r.size, r.taken, r.source_size, round(r.target, 6)) for r in rs)
    want = key(mixing.mix(df).collect())
    monkeypatch.setattr(mixing, "DRIVER_SOURCES", 0)
    assert key(mixing.mix(df).collect()) == want


def test_mixed_rows(spark):
    df = table(spark, rows_of(400))
    want = {}
    for r in mixing.mix(df).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
    out = mixing.mixed(df)
    assert out.columns == df.columns
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {d: n for d, n in want.items() if n}


def test_empty(spark):
    assert mixing.mix(table(spark, [])).collect() == []
