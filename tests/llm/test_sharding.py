import pytest

from textloom.llm import sharding
from textloom.llm.common import work_dir
from textloom.llm.sharding import Conflict, Shard, ShardStore


def frame(spark, n, start=0):
    rows = [(i if i % 50 else None, None if i % 9 == 0 else f"text {i} " * (i % 40 if i % 333 else 20000), None, f"s{i}", i) for i in range(start, start + n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, shard string, version int").repartition(4)


def test_plan():
    small = [Shard("a", f"{i:03}", 1000, 1) for i in range(10)]
    big = [Shard("b", "0", 900_000, 1)]
    assert sharding.plan(small + big, target_bytes=4000, fan_in=4) == [small[:4], small[4:8], small[8:]]
    assert sharding.plan(small[:3], target_bytes=4000, fan_in=4) == []
    assert sharding.plan([], target_bytes=4000) == []
    groups = sharding.plan([Shard("a", f"{i:03}", 1 + i * 97, 1) for i in range(200)], target_bytes=20_000)
    assert all(sum(s.bytes for s in g) <= 20_000 for g in groups)


def all_shards(store, version=None):
    return list(store.shards(store.manifest(version).lists))


def test_rows_survive(spark):
    store = ShardStore(spark, work_dir(spark, "t"), target_bytes=200_000, fan_in=4)
    for k in range(3):
        store.append(frame(spark, 500, 500 * k), rows=50)
    before = all_shards(store)
    assert store.manifest().version == 3 and len(before) >= 30 and all(s.rows <= 50 for s in before)
    after = store.compact()
    assert after.n_shards < len(before) / 2 and sum(s.rows for s in all_shards(store)) == 1500
    assert all(sum(s.bytes for s in g) <= 200_000 for g in sharding.plan(before, target_bytes=200_000))
    assert sharding.plan(all_shards(store), target_bytes=200_000, fan_in=4) == []  # no tier is full
    want = sorted(map(tuple, frame(spark, 1500).collect()), key=str)
    for version in (3, None):
        assert sorted(map(tuple, store.read(version).collect()), key=str) == want
    orphan = f"{store.root}/data/failed"
    frame(spark, 5).write.parquet(orphan)
    store.vacuum()
    assert store.versions() == [after.version] and "failed" not in store._names("data")
    assert sorted(map(tuple, store.read().collect()), key=str) == want
    assert sum(len([f for f in store._names(f"data/{r}") if f.endswith(".parquet")]) for r in store._names("data")) == after.n_shards
    assert len(store._names("lists")) == len(after.lists) or all(not n.endswith(".json") or n in {x.path for x in after.lists} for n in store._names("lists"))
    placed = store.placement("doc_id").collect()
    by = {}
    for r in placed:
        by.setdefault((r.shard, r.shard_rows), []).append(r)
    assert all(n == len(x) for (_, n), x in by.items()) and len(by) == after.n_shards


def test_small_jobs_end_in_the_same_state(spark, monkeypatch):
    monkeypatch.setattr(sharding, "JOB_SHARDS", 3)
    monkeypatch.setattr(sharding, "LIST_SHARDS", 7)
    store = ShardStore(spark, work_dir(spark, "t"), target_bytes=60_000, fan_in=4)
    store.append(frame(spark, 600), rows=20)
    after = store.compact()
    assert after.version > 2 and after.n_shards < 30
    assert sorted(map(tuple, store.read().collect()), key=str) == sorted(map(tuple, frame(spark, 600).collect()), key=str)
    assert store.placement("doc_id").count() == 600


def test_commit_is_exclusive(spark):
    store = ShardStore(spark, work_dir(spark, "t"))
    base = store.manifest()
    store.commit(base, store.list_shards([Shard("x", "1", 1, 1)]), None)
    with pytest.raises(Conflict):
        store.commit(base, [], None)
    assert all_shards(store) == [Shard("x", "1", 1, 1)]


def test_a_lost_race_leaves_nothing_behind(spark, monkeypatch):
    """Another compaction commits between this one's merge and its commit."""
    store = ShardStore(spark, work_dir(spark, "t"), target_bytes=200_000, fan_in=4)
    store.append(frame(spark, 300), rows=20)
    other, write = ShardStore(spark, store.root, target_bytes=200_000, fan_in=4), store._write

    def slow(*args, **options):
        out = write(*args, **options)
        other.compact()
        return out

    monkeypatch.setattr(store, "_write", slow)
    with pytest.raises(Conflict):
        store.compact()
    assert set(store._names("data")) == {x.run for v in store.versions() for x in store.manifest(v).lists}
    assert store.read().count() == 300


def test_shard_and_empty(spark):
    df = frame(spark, 700)
    out = sharding.shard(df, work_dir(spark, "t"), arrival_rows=64, target_bytes=100_000)
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(r.doc_id) for r in df.collect())
    assert sharding.shard(frame(spark, 0), work_dir(spark, "t")).collect() == []
