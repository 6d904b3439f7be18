import numpy as np
import pytest

from textloom.config import EmbedConfig, autoscale, hidden_dim, parse_format, parse_sizes
from textloom.errors import ConfigError, ModelError
from textloom.operators import models
from textloom.operators.encoders import HashEncoder, l2_normalize, mean_pool, output_name
from textloom.plans.engine import Engine, word_hash_tokenizer
from textloom.shared import work_dir
from textloom.sources import sinks
from textloom.streaming.monitor import observed


def messages(spark, n=400):
    rows = [(i, f"id{i}" if i % 3 else "", ["12 34", "short", f"some words number{i % 40} here " * (1 + i % 12)][2 if i % 10 else i % 20 // 10]) for i in range(n)]
    return spark.createDataFrame(rows, "seq long, id string, text string")


SMALL = dict(buckets=(8, 16, 64), batch_sizes=(16, 8, 4))


@pytest.mark.parametrize("dedup", [0, 1])
def test_every_message_once(spark, dedup):
    df = messages(spark)
    result = Engine(EmbedConfig(dedup_capacity=dedup, **SMALL)).embed(df.repartition(5))
    rows = {r.seq: r for r in result.df.collect()}
    assert sorted(rows) == list(range(400)) and result.df.count() == 400
    assert all(r.status == ("ok" if i % 10 else "skipped") for i, r in rows.items())
    for r in rows.values():
        assert (r.embedding is None) == (r.status == "skipped")
        assert r.embedding is None or abs(np.linalg.norm(r.embedding) - 1) < 1e-5
    stats = result.stats()
    assert (stats.messages_processed, stats.messages_skipped, stats.messages_failed) == (360, 40, 0)
    assert 0 < stats.fill_ratio <= 1 and sum(stats.per_bucket_batches) == stats.batches_computed == sum(stats.per_partition_batches)
    assert stats.dedup_hits == (360 - stats.dedup_size if dedup else 0)
    assert '"messages_processed": 360' in stats.to_json() and stats.throughput > 0


def test_results_depend_on_neither_batches_nor_partitions(spark):
    df = messages(spark)
    runs = [Engine(EmbedConfig(dedup_capacity=d, **kw)).embed(df.repartition(p)).df.collect() for d, p, kw in ((0, 1, SMALL), (1, 8, SMALL), (0, 3, dict(buckets=(64,), batch_sizes=(3,))))]
    first = {r.seq: r.embedding for r in runs[0]}
    for run in runs[1:]:
        for r in run:
            assert (r.embedding is None) == (first[r.seq] is None) and (r.embedding is None or np.allclose(r.embedding, first[r.seq], atol=1e-6))


def test_a_failed_batch_costs_its_own_rows(spark):
    class Failing(HashEncoder):  # local, so that it travels to the workers by value
        def encode(self, ids, mask):
            if (mask.sum(1) > 40).any():
                raise RuntimeError("too long")
            return HashEncoder.encode(self, ids, mask)

    result = Engine(EmbedConfig(**SMALL), Failing()).embed(messages(spark))
    by = {r.status: r["count"] for r in result.df.groupBy("status").count().collect()}
    assert by["skipped"] == 40 and by["failed"] > 0 and by["ok"] > 0 and sum(by.values()) == 400
    assert result.stats().messages_failed == by["failed"]


def test_sinks(spark, tmp_path):
    result = Engine(EmbedConfig()).embed(messages(spark).repartition(6))
    rows = sorted((r for r in result.df.collect() if r.status == "ok"), key=lambda r: r.seq)
    path = f"file://{tmp_path}/v.npy"
    sinks.write_vectors(result.df, path, 8)
    got = np.load(f"{tmp_path}/v.npy")
    assert got.dtype == np.float32 and got.shape == (len(rows), 8) and np.allclose(got, [r.embedding for r in rows])
    sinks.write_parquet(result.df, f"file://{tmp_path}/v.parquet", single=True)
    back = spark.read.parquet(f"file://{tmp_path}/v.parquet").collect()
    assert [r.id for r in back] == [r.id or str(r.seq) for r in rows]
    line = sinks.preview(result.df).first().line
    assert line.count("\t") == 1 and len(line.split("\t")[1].split()) == 3
    empty = work_dir(spark, "empty.npy")
    assert sinks.write_npy(result.df.where("seq < 0"), empty, 8) == 0
    sinks.write_results(spark.createDataFrame([("a", 1.5)], "system string, rate double"), f"file://{tmp_path}/r")
    assert spark.read.json(f"file://{tmp_path}/r/json").first().rate == 1.5


def test_npy_is_read_in_ranges(spark, tmp_path, monkeypatch):
    """A file's rows are read by many tasks, whether a row is one record of the file or several."""
    monkeypatch.setattr(sinks, "NPY_SPLIT", 4096)
    for dim in (8, 12, 2):
        want = np.random.default_rng(dim).normal(size=(1000, dim)).astype(np.float32)
        df = spark.createDataFrame([(i, "ok", v.tolist()) for i, v in enumerate(want)], "seq long, status string, embedding array<float>").repartition(7)
        path = f"file://{tmp_path}/{dim}.npy"
        assert sinks.write_npy(df, path, dim) == 1000
        found = sinks.read_npy(spark, path, dim)
        rows = sorted((r.at, r.found) for r in found.collect())
        assert [a for a, _ in rows] == list(range(1000)) and np.array_equal(np.array([v for _, v in rows], np.float32), want)
        assert dim != 8 or found.rdd.getNumPartitions() > 5
    sinks.write_npy(df.where("seq < 0"), f"file://{tmp_path}/none.npy", 2)
    assert sinks.read_npy(spark, f"file://{tmp_path}/none.npy", 2).count() == 0


def test_hash_encoder_holds_little(monkeypatch):
    """Pooling goes by parts of a batch and remembers a bounded number of vectors, with the same result."""
    import tracemalloc

    ids = np.random.default_rng(1).integers(3, 250_003, (4096, 256))
    mask = np.ones_like(ids)
    encoder = HashEncoder(8)
    few = encoder.encode(ids[:50], mask[:50])
    assert np.allclose(HashEncoder(8).encode(ids[:1], mask[:1]), few[:1])
    encoder.encode(ids[:512], mask[:512])
    assert len(encoder._vectors) <= 20_000
    ids %= 5000
    encoder.encode(ids, mask)
    tracemalloc.start()
    encoder.encode(ids, mask)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 90e6  # 4096 x 256 x 8 doubles are 67 MB, twice so while they are summed


def test_observed_counts(spark):
    df, seen = observed(Engine(EmbedConfig(**SMALL)).plan(messages(spark)))
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 400, "ok": 360, "skipped": 40, "failed": 0}


def test_vector_math():
    assert mean_pool(np.array([[[1.0, 3], [3, 5]]]), np.array([[1, 1]])).tolist() == [[2, 4]]
    assert mean_pool(np.array([[[1.0, 3], [3, 5]]]), np.array([[0, 0]])).tolist() == [[0, 0]]
    assert np.allclose(l2_normalize(np.array([[3.0, 4], [0, 0]])), [[0.6, 0.8], [0, 0]])
    assert word_hash_tokenizer(5)(["a b c d e"])[0][0] == 0 and len(word_hash_tokenizer(5)(["a b c d e"])[0]) == 5
    assert output_name(["x"]) == "x" and output_name(["pooler", "last_hidden_state"]) == "last_hidden_state"
    with pytest.raises(ModelError):
        output_name(["a", "b"])


def test_config():
    assert [autoscale(b, 1024) for b in (4096, 512, 64)] == [3072, 384, 64] and autoscale(512, 768) == 512
    assert hidden_dim({"hidden_size": 5, "d_model": 6}) == 5 and hidden_dim({"d_model": 6}) == 6 and hidden_dim({}) == 384
    for bad in (dict(buckets=(), batch_sizes=()), dict(buckets=(8,), batch_sizes=(1, 2)), dict(buckets=(8, 8), batch_sizes=(1, 1)), dict(buckets=(8,), batch_sizes=(0,)), dict(truncation=0), dict(tokenize_workers=0)):
        with pytest.raises(ConfigError, match="config: "):
            EmbedConfig(**bad)
    assert parse_sizes("1, 2") == (1, 2) and parse_format("plain") == "plain"
    for f, x in ((parse_sizes, "a"), (parse_sizes, ""), (parse_format, "csv")):
        with pytest.raises(ConfigError):
            f(x)


def test_models(tmp_path):
    assert models.full_name("e5-small-v2") == "intfloat/e5-small-v2" and models.full_name(str(tmp_path)) == str(tmp_path)
    for name in ("intfloat/e5-small-v2", "some/other"):
        with pytest.raises(ModelError):
            models.resolve(name, str(tmp_path))
    folder = tmp_path / "intfloat--e5-small-v2"
    folder.mkdir()
    for f in models.FILES:
        (folder / f).write_text('{"hidden_size": 384}')
    assert models.resolve("e5-small-v2", str(tmp_path)) == (str(folder), 384) == models.resolve(str(folder), "/none")
    assert not models.fresh(str(folder), {"a": 1})
    models.record(str(folder), {"a": 1})
    assert models.fresh(str(folder), {"a": 1}) and not models.fresh(str(folder), {"a": 2})


def test_engine_without_a_model_file(tmp_path):
    with pytest.raises(ModelError):
        Engine(EmbedConfig(model="e5-small-v2", model_dir=str(tmp_path)))


def field(number: int, value) -> bytes:
    """One field of a protocol buffer: a number, or bytes with their length."""

    def varint(n: int) -> bytes:
        out = b""
        while n > 0x7F:
            out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
        return out + bytes([n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def tiny_model(table: np.ndarray) -> bytes:
    """An ONNX model whose last hidden state is each token's row of ``table``."""
    kind = lambda name, elem, *dims: field(1, name) + field(2, field(1, field(1, elem) + field(2, b"".join(field(1, field(2, d) if isinstance(d, str) else field(1, d)) for d in dims))))
    gather = field(1, "table") + field(1, "input_ids") + field(2, "last_hidden_state") + field(4, "Gather")
    values = b"".join(field(1, d) for d in table.shape) + field(2, 1) + field(8, "table") + field(9, table.astype("<f4").tobytes())
    graph = field(1, gather) + field(2, "g") + field(5, values) + field(11, kind("input_ids", 7, "n", "t")) + field(12, kind("last_hidden_state", 1, "n", "t", table.shape[1]))
    return field(1, 8) + field(8, field(2, 13)) + field(7, graph)


def test_a_model_from_folder_to_vectors(spark, tmp_path):
    """model.onnx, tokenizer.json and the vocabulary cache, run through the engine, against the same sums in numpy."""
    from tokenizers import Tokenizer, models as kinds, pre_tokenizers

    from textloom.operators import vocab

    known = {"<s>": 0, "<pad>": 1, "</s>": 2, "<unk>": 3, "▁some": 4, "▁words": 5, "▁here": 6, **{f"▁number{i}": 7 + i for i in range(30)}}
    tokenizer = Tokenizer(kinds.WordLevel(known, unk_token="<unk>"))
    tokenizer.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    folder = tmp_path / "model"
    folder.mkdir()
    tokenizer.save(str(folder / "tokenizer.json"))
    table = np.random.default_rng(0).normal(size=(40, 6)).astype(np.float32)
    (folder / "model.onnx").write_bytes(tiny_model(table))
    (folder / "config.json").write_text('{"hidden_size": 6}')
    vocab.save(str(folder / "vocab_cache.bin"), {"▁some": [4], "▁words": [5]})
    engine = Engine(EmbedConfig(model=str(folder), prefix="", **SMALL))
    assert engine.hidden_dim == 6
    df = messages(spark)
    result = engine.embed(df.repartition(3))
    text = {r.seq: r.text for r in df.collect()}
    rows = result.df.collect()
    assert sum(r.status == "ok" for r in rows) == 360 and not any(r.status == "failed" for r in rows)
    for r in rows:
        if r.status == "ok":
            ids = [0, *(known.get(f"▁{w}", 3) for w in text[r.seq].encode()[:256].decode().split())][:63] + [2]
            want = table[ids].mean(0)
            assert np.allclose(r.embedding, want / np.linalg.norm(want), atol=1e-5), r.seq
    stats = result.stats()
    assert stats.cache_hits > 0 and stats.cache_misses > 0 and stats.runtime_cache_hits > 0
    assert result.missing(df).count() == 0 and result.missing(df.unionByName(df.limit(1).withColumn("seq", df.seq + 1000))).count() == 1
