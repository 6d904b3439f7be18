"""The embedding engine: one lazy plan from messages to vectors."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import EmbedConfig
from ..functions.normalize import normalize
from ..operators.dedup import once_per_text
from ..operators.encoders import Encoder, HashEncoder
from ..operators.metrics import EmbedStats
from ..shared import store


#: Texts of a batch to their token ids.
Tokenizer = Callable[[list[str]], list[list[int]]]


def word_hash_tokenizer(max_len: int) -> Tokenizer:
    """A tokenizer without a vocabulary: a word's id is its checksum, 0 and 2 stand around the text."""
    import zlib

    def tokenize(texts: list[str]) -> list[list[int]]:
        return [[0, *(3 + zlib.crc32(w.encode()) % 250_000 for w in t.split()[: max_len - 2]), 2] for t in texts]

    return tokenize


#: Rows that a task tokenizes at a time.
TOKENIZED_ROWS = 1024

ENCODED = T.StructType(
    [
        T.StructField("norm_text", T.StringType()),
        T.StructField("n_tokens", T.IntegerType()),
        T.StructField("bucket", T.IntegerType()),
        T.StructField("batch", T.StringType()),
        T.StructField("batch_size", T.IntegerType()),
        T.StructField("failed", T.BooleanType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("hits", T.LongType()),
        T.StructField("runtime_hits", T.LongType()),
        T.StructField("misses", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("id", T.StringType()),
    ]
)


def encode_texts(texts: DataFrame, config: EmbedConfig, encoder: Encoder, make_tokenizer: Callable[[], Tokenizer]) -> DataFrame:
    """ENCODED rows of (norm_text[, seq, id]): tokenized, batched by bucket within each task, encoded.

    A batch holds rows of one bucket, at most its batch size; a batch that fails marks its own
    rows only. Rows without a text pass through. Tasks keep one unfinished batch a bucket, which
    is all the memory they need.
    """
    buckets, sizes = config.buckets, config.scaled(encoder.dim)
    keyed = texts if "seq" in texts.columns else texts.select("norm_text", F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part = context.partitionId() if context else 0
        encoder.load()
        tokenize = make_tokenizer()
        waiting: list[list[tuple[str, tuple, np.ndarray]]] = [[] for _ in buckets]
        done = [0] * len(buckets)
        before = [0, 0, 0]

        def flush(k: int) -> pa.RecordBatch:
            rows = waiting[k]
            waiting[k] = []
            ids = np.zeros((len(rows), buckets[k]), np.int64)
            mask = np.zeros_like(ids)
            for i, (_, _, tokens) in enumerate(rows):
                n = min(len(tokens), buckets[k])
                ids[i, :n], mask[i, :n] = tokens[:n], 1
            try:
                vectors, failed = encoder.encode(ids, mask), False
            except Exception:  # noqa: BLE001  a failed batch costs its own rows only
                vectors, failed = None, True
            now = [getattr(tokenize, a, 0) for a in ("hits", "runtime_hits", "misses")]
            counts = [n - b for n, b in zip(now, before)]
            before[:] = now
            first = [[c] + [0] * (len(rows) - 1) for c in counts]
            n = len(rows)
            name = f"{part}-{k}-{done[k]}"
            done[k] += 1
            values = pa.array([None] * n, pa.list_(pa.float32())) if failed else pa.ListArray.from_arrays(np.arange(0, n * encoder.dim + 1, encoder.dim, dtype=np.int32), pa.array(np.ascontiguousarray(vectors, np.float32).ravel()))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([t for t, _, _ in rows]),
                    pa.array([min(len(x), buckets[k]) for _, _, x in rows], pa.int32()),
                    pa.array([k] * n, pa.int32()),
                    pa.array([name] * n),
                    pa.array([sizes[k]] * n, pa.int32()),
                    pa.array([failed] * n),
                    values,
                    *(pa.array(c, pa.int64()) for c in first),
                    pa.array([r[0] for _, r, _ in rows], pa.int64()),
                    pa.array([r[1] for _, r, _ in rows], pa.string()),
                ],
                names=ENCODED.names,
            )

        def passed(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.list_(pa.float32()), *[pa.int64()] * 3]
            return pa.RecordBatch.from_arrays([*(pa.array([None] * len(rows), k) for k in kinds), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=ENCODED.names)

        for b in (b.slice(i, TOKENIZED_ROWS) for b in batches for i in range(0, b.num_rows, TOKENIZED_ROWS)):
            rows = list(zip(*(c.to_pylist() for c in b.columns)))
            empty = [key for text, *key in rows if text is None]
            some = [r for r in rows if r[0] is not None]
            for (text, *key), tokens in zip(some, tokenize([r[0] for r in some])):
                k = min(int(np.searchsorted(buckets, len(tokens))), len(buckets) - 1)
                waiting[k].append((text, key, np.array(tokens, np.int64)))
                if len(waiting[k]) >= sizes[k]:
                    yield flush(k)
            if empty:
                yield passed(empty)
        for k in range(len(buckets)):
            if waiting[k]:
                yield flush(k)

    return keyed.select("norm_text", "seq", "id").mapInArrow(run, ENCODED)


@dataclass
class EmbedResult:
    """``df``: seq, id, status (ok, skipped or failed), bucket, n_tokens, embedding."""

    df: DataFrame
    config: EmbedConfig
    dim: int
    _full: DataFrame
    _encoded: DataFrame
    _started: float = field(default_factory=time.time)

    def missing(self, messages: DataFrame) -> DataFrame:
        """(seq) of ``messages`` that have no row in the result: none, unless rows were lost."""
        return messages.select("seq").join(self.df.select("seq"), "seq", "left_anti")

    def stats(self) -> EmbedStats:
        """Aggregates of this run, each over stored rows."""
        rows = self._full.agg(F.count_if(F.col("status") != "skipped").alias("p"), F.count_if(F.col("status") == "skipped").alias("s"), F.count_if(F.col("status") == "failed").alias("f")).first()
        distinct = self._encoded.select("norm_text").distinct().count()
        batches = self._encoded.groupBy("bucket", "batch").agg(F.count("*").alias("n"), F.first("batch_size").alias("size"), F.sum("hits").alias("hits"), F.sum("runtime_hits").alias("rt"), F.sum("misses").alias("misses"))
        by = {r.bucket: r for r in batches.groupBy("bucket").agg(F.count("*").alias("b"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.sum("hits").alias("hits"), F.sum("rt").alias("rt"), F.sum("misses").alias("misses")).collect()}
        parts = batches.groupBy(F.substring_index("batch", "-", 1).cast("int").alias("p")).count().orderBy("p").collect()
        total = lambda c: sum(getattr(r, c) for r in by.values())
        k = range(len(self.config.buckets))
        return EmbedStats(
            messages_processed=rows.p,
            messages_skipped=rows.s,
            messages_failed=rows.f,
            batches_computed=total("b"),
            fill_ratio=total("n") / total("size") if by else 0.0,
            dedup_hits=rows.p - distinct if self.config.dedup_capacity else 0,
            dedup_size=distinct if self.config.dedup_capacity else 0,
            per_bucket_batches=tuple(by[i].b if i in by else 0 for i in k),
            per_bucket_messages=tuple(by[i].n if i in by else 0 for i in k),
            per_partition_batches=tuple(r["count"] for r in parts),
            cache_hits=total("hits"),
            cache_misses=total("misses"),
            runtime_cache_hits=total("rt"),
            hidden_dim=self.dim,
            elapsed_s=time.time() - self._started,
        )


class Engine:
    """Embeds DataFrames of (seq, id, text); usable any number of times."""

    def __init__(self, config: EmbedConfig | None = None, encoder: Encoder | None = None, make_tokenizer: Callable[[], Tokenizer] | None = None):
        self.config = config or EmbedConfig()
        if encoder is None and self.config.model:
            from ..operators.encoders import OnnxEncoder
            from ..operators.models import resolve

            folder, dim = resolve(self.config.model, self.config.model_dir)
            encoder = OnnxEncoder(folder, dim)
            make_tokenizer = make_tokenizer or model_tokenizer(folder, self.config.buckets[-1])
        self.encoder = encoder or HashEncoder(self.config.dim)
        longest = self.config.buckets[-1]
        self.make_tokenizer = make_tokenizer or (lambda: word_hash_tokenizer(longest))

    @property
    def hidden_dim(self) -> int:
        return self.encoder.dim

    def plan(self, messages: DataFrame) -> DataFrame:
        """``messages`` with norm_text, status and what the encoder made of them.

        Nothing runs yet, but that texts to be told apart (``dedup_capacity``) are normalized and stored.
        """
        c = self.config
        text = normalize(F.col("text"), lowercase=c.lowercase, max_bytes=c.truncation, min_bytes=c.min_bytes, prefix=c.prefix)
        rows = messages.select(F.col("seq").cast("long").alias("seq"), F.col("id").cast("string").alias("id"), text.alias("norm_text"))
        if c.dedup_capacity:
            out = once_per_text(rows, "norm_text", lambda texts: encode_texts(texts, c, self.encoder, self.make_tokenizer).drop("seq", "id"))
        else:  # one pass, nothing is shuffled
            out = encode_texts(rows, c, self.encoder, self.make_tokenizer)
        status = F.when(F.col("norm_text").isNull(), "skipped").when(F.col("failed"), "failed").otherwise("ok")
        return out.withColumn("status", status)

    def embed(self, messages: DataFrame) -> EmbedResult:
        """Vectors for every message; the encoded rows are stored once and read by result and statistics."""
        started = time.time()
        full = store(self.plan(messages), "embedded")
        encoded = full.where("batch is not null")
        if self.config.dedup_capacity:
            encoded = encoded.dropDuplicates(["norm_text"])
        df = full.select("seq", "id", "status", "bucket", "n_tokens", "embedding")
        return EmbedResult(df, self.config, self.hidden_dim, full, encoded, started)


def model_tokenizer(folder: str, max_len: int) -> Callable[[], Tokenizer]:
    """Makes the cached tokenizer of a model's folder in a worker."""

    def make():
        import os

        import tokenizers

        from textloom.operators import vocab
        from textloom.operators.tokenize import Words

        path = os.path.join(folder, "vocab_cache.bin")
        return Words(tokenizers.Tokenizer.from_file(os.path.join(folder, "tokenizer.json")), max_len, vocab.load(path) if vocab.count(path) else {})

    return make
