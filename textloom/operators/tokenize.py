"""Word-wise tokenization against a vocabulary, in the task or as a join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import with_specials
from ..shared import store
from .vocab import MARK

#: Words that a worker remembers besides the vocabulary's, and bytes of a word that it remembers.
RUNTIME_WORDS, RUNTIME_BYTES = 500_000, 45
#: Words of a vocabulary that is sent to every task; a larger one is joined.
BROADCAST_WORDS = 200_000
UNKNOWN = 3


class Words:
    """Token ids of texts, a batch at a time: every distinct word of a batch is resolved once.

    ``known`` answers marked words; the rest goes to ``tokenizer`` in one call and is remembered.
    Words without an answer are unknown. ids of a text's words stand between two outer ones,
    ``max_len`` in all at most, so that the last word may be cut. Words behind a cut count neither
    as hits nor as misses; a word's first use in the worker is a miss unless the vocabulary has it.
    """

    def __init__(self, tokenizer, max_len: int, known: dict[str, list[int]] | None = None):
        self.tokenizer, self.max_len, self.known = tokenizer, max_len, known or {}
        outer = [tokenizer.token_to_id(t) if tokenizer is not None else None for t in ("<s>", "</s>")]
        self.cls, self.sep = (own if given is None else given for given, own in zip(outer, (0, 2)))
        self.remembered: dict[str, list[int]] = {}
        self.hits = self.runtime_hits = self.misses = 0

    def _ask(self, words: list[str]) -> list[list[int]]:
        if self.tokenizer is None:
            return [[UNKNOWN]] * len(words)
        marked = [MARK + w for w in words]
        try:
            return [list(e.ids) for e in self.tokenizer.encode_batch(marked, add_special_tokens=False)]
        except Exception:  # noqa: BLE001  one that can't be encoded spoils the call
            return [self._alone(w) for w in marked]

    def _alone(self, marked: str) -> list[int]:
        try:
            return list(self.tokenizer.encode(marked, add_special_tokens=False).ids)
        except Exception:  # noqa: BLE001  an unencodable word is an unknown token
            return [UNKNOWN]

    def __call__(self, texts: list[str]) -> list[list[int]]:
        split = [t.split() for t in texts]
        number: dict[str, int] = {}
        uses = np.fromiter((number.setdefault(w, len(number)) for ws in split for w in ws), np.int64)
        ids: list[list[int] | None] = [self.known.get(MARK + w) for w in number]
        in_known = np.array([i is not None for i in ids], bool)
        ids = [self.remembered.get(w) if i is None else i for w, i in zip(number, ids)]
        fresh = [k for k, i in enumerate(ids) if i is None]
        spelled = list(number)
        for k, answer in zip(fresh, self._ask([spelled[k] for k in fresh]) if fresh else []):
            ids[k] = answer
        new = np.zeros(len(ids), bool)
        new[fresh] = True
        # All words' ids in a row, and which of them each text keeps.
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for i in ids for x in i), np.int64, int(size.sum()))
        begin = np.cumsum(size) - size
        out, at, used = [], 0, np.zeros(len(ids), np.int64)
        for ws in split:
            own = uses[at : at + len(ws)]
            at += len(ws)
            ends = np.cumsum(size[own])
            own = own[ends - size[own] < self.max_len - 2]
            np.add.at(used, own, 1)
            n = size[own]
            place = np.repeat(begin[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            out.append([self.cls, *flat[place[: self.max_len - 2]].tolist(), self.sep])
        first = new & (used > 0)
        self.misses += int(first.sum())
        again = int((used * ~in_known).sum() - first.sum())
        self.runtime_hits += again
        self.hits += int((used * in_known).sum()) + again
        for k in np.flatnonzero(first).tolist():
            if len(self.remembered) < RUNTIME_WORDS and len(spelled[k].encode()) <= RUNTIME_BYTES:
                self.remembered[spelled[k]] = ids[k]
        return out

    @property
    def hit_rate(self) -> float:
        total = self.hits + self.misses
        return self.hits / total if total else 0.0


def token_ids(texts: DataFrame, vocab: DataFrame, *, key: str, column: str = "text", max_len: int = 256, unknown: int = UNKNOWN) -> DataFrame:
    """(key, ids): words of ``column`` looked up in ``vocab`` (word, ids; stored), unknown ones one token.

    A vocabulary of up to BROADCAST_WORDS words is sent to the tasks; a larger one is joined, word by word.
    """
    if vocab.limit(BROADCAST_WORDS + 1).count() > BROADCAST_WORDS:
        return _joined_ids(texts, vocab, key, column, max_len, unknown)
    known = texts.sparkSession.sparkContext.broadcast({MARK + r.word: list(r.ids) for r in vocab.select("word", "ids").collect()})
    slim = texts.select(key, F.col(column).cast("string").alias("text"))
    schema = T.StructType([slim.schema[0], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(None, max_len, known.value)
        for b in batches:
            found = words([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32()))], names=schema.names)

    return slim.mapInArrow(run, schema)


def _joined_ids(texts: DataFrame, vocab: DataFrame, key: str, column: str, max_len: int, unknown: int) -> DataFrame:
    texts = store(texts.select(key, column), "texts")  # read twice, made once
    each = texts.select(key, F.posexplode(F.split(column, " ")).alias("pos", "word")).where("word != ''")
    found = each.join(vocab, "word", "left").withColumn("ids", F.coalesce("ids", F.array(F.lit(unknown))))
    rows = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("pieces"))
    out = texts.select(key).join(rows, key, "left")
    pieces = F.coalesce(F.col("pieces.ids"), F.array().cast("array<array<int>>"))
    return out.select(key, with_specials(pieces, max_len).alias("ids"))


def hit_rate(texts: DataFrame, vocab: DataFrame, column: str = "text") -> DataFrame:
    """One row: words, hits and hit_rate of a vocabulary (word)."""
    counts = texts.select(F.explode(F.split(column, " ")).alias("word")).where("word != ''").groupBy("word").agg(F.count("*").alias("n"))
    known = vocab.select("word", F.lit(1).alias("known"))
    hits = F.coalesce(F.sum(F.when(F.col("known") == 1, F.col("n"))), F.lit(0))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return counts.join(known, "word", "left").agg(total.alias("words"), hits.alias("hits"), F.coalesce(F.try_divide(hits, total), F.lit(0.0)).alias("hit_rate"))
