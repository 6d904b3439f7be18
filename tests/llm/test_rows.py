"""Stages decide row by row: null ids, equal ids of different texts, repeats, and columns named like private ones."""

import pytest

from textloom.llm import common, decontam, mixing, quality, sharding, simhash
from test_quality import prose

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
COLUMNS = "doc_id long, text string, source string, __id string, __size long, __f string, key0 long, n int, row string, gone0 long"
GOOD, OTHER, SHORT, BAD = prose(1), prose(2), "too short", f"{prose(3)} {ITEM}"


def table(spark, rows, columns=COLUMNS):
    return spark.createDataFrame([(i, t, s, "i", 5, "f", 7, 1, f"r{k}", 2) for k, (i, t, s) in enumerate(rows)], columns).repartition(3)


def texts(df):
    return sorted((str(r.doc_id), r.text or "") for r in df.collect())


def test_quality_goes_by_row(spark):
    rows = [(None, GOOD, "a"), (None, SHORT, "a"), (5, GOOD, "a"), (5, SHORT, "b"), (6, None, None), (7, OTHER, None), (7, OTHER, None), (8, "", "a")]
    out = quality.keep_good(table(spark, rows))
    assert out.columns == table(spark, rows).columns
    assert texts(out) == sorted([("None", GOOD), ("5", GOOD), ("7", OTHER), ("7", OTHER)])


@pytest.mark.parametrize("most", [common.BROADCAST_KEYS, 0])
def test_decontamination_goes_by_row(spark, monkeypatch, most):
    monkeypatch.setattr(common, "BROADCAST_KEYS", most)
    rows = [(None, GOOD, "a"), (None, BAD, "a"), (5, GOOD, "a"), (5, BAD, "b"), (6, None, None), (6, BAD, "a")]
    bench = spark.createDataFrame([("item-x", ITEM, 1)], "item_id string, text string, doc_id int")
    out = decontam.decontaminate(table(spark, rows), bench)
    assert texts(out) == sorted([("None", GOOD), ("5", GOOD), ("6", "")])


@pytest.mark.parametrize("most", [common.BROADCAST_KEYS, 0])
def test_near_duplicates_go_by_row(spark, monkeypatch, most):
    monkeypatch.setattr(common, "BROADCAST_KEYS", most)
    rows = [(None, GOOD, "a"), (None, GOOD.upper(), "a"), (5, GOOD, "b"), (5, prose(7), "b"), (6, prose(7), None), (None, prose(8), "q"), (None, prose(8), "p"), (3, None, "a"), (None, "", "b")]
    df = table(spark, rows)
    out = simhash.drop_near_duplicates(df)
    assert out.columns == df.columns
    assert texts(out) == sorted([("5", GOOD), ("5", prose(7)), ("None", prose(8)), ("3", "")])
    same = spark.createDataFrame([(9, OTHER, "z")] * 4 + [(None, OTHER, "z")] * 3 + [(None, GOOD, None)] * 5, "doc_id long, text string, source string")
    assert texts(simhash.drop_near_duplicates(same)) == sorted([("9", OTHER), ("None", GOOD)])


def test_mixing_splits_equal_rows(spark):
    """A thousand rows without an id make up a source: its target is met all the same."""
    rows = [(None, "one two three four", "a")] * 1000 + [(i, "w " * (1 + i % 9), "b") for i in range(400)] + [(1, "x y", "b")] * 7
    df = table(spark, rows)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    for s in "ab":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own) + 1e-6
        assert all(r.taken <= 3 * r.size for r in own)
    assert len({r.taken for r in got if r.doc_id is None}) == 2


@pytest.mark.parametrize("repeats", [mixing.REPEATS, 3])
def test_mixed_repeats_equal_rows(spark, monkeypatch, repeats):
    monkeypatch.setattr(mixing, "REPEATS", repeats)
    rows = [(None, "one two three four", "a")] * 300 + [(i, "w " * (1 + i % 9), "b") for i in range(400)]
    df = spark.createDataFrame([(i, t, s, "x", 1) for i, t, s in rows], "doc_id long, text string, source string, __size string, times int")
    for weights in ((1, 2, 3), (5, 1), (1, 40)):
        out = mixing.mixed(df, weights=weights)
        assert out.columns == df.columns
        goal = mixing.targets({"a": 1200, "b": sum(1 + i % 9 for i in range(400))}, weights)
        words = {"a": 0, "b": 0}
        for r in out.collect():
            words[r.source] += len(r.text.split())
        assert abs(words["a"] - goal["a"]) <= 4 and abs(words["b"] - goal["b"]) <= 9
        # mix repeats the same rows: by id, as often
    key = lambda rs: sorted((str(r.doc_id), r.text) for r in rs)
    assert key(mixing.mixed(df).collect()) == key(mixing.mixed(df.repartition(5)).collect())


def test_shards_with_clashing_names(spark):
    df = table(spark, [(1, GOOD, "a"), (None, None, None), (1, GOOD, "a")], COLUMNS.replace("gone0 long", "__r long"))
    assert sorted(str(r.doc_id) for r in sharding.shard(df, common.work_dir(spark, "shards")).collect()) == ["1", "1", "None"]


def test_stages_on_empty_tables(spark):
    df = table(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    assert quality.keep_good(df).count() == simhash.drop_near_duplicates(df).count() == mixing.mixed(df).count() == decontam.decontaminate(df, bench).count() == 0
