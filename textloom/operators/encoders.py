"""Encoders: token ids and masks of a batch to one vector a row."""

from __future__ import annotations

import hashlib
import os
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InferenceError, ModelError
from ..functions.vectors import hash_component
from ..functions.vectors import l2_normalize as unit_vector


class Encoder(Protocol):
    dim: int

    def load(self) -> None:
        """Called once in a worker before the first batch."""

    def encode(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """(rows, tokens) int64 ids and mask to (rows, dim) float32 vectors of unit length."""


def mean_pool(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean over unmasked tokens of (rows, tokens, dim); zeros for rows without any."""
    m = mask[..., None].astype(hidden.dtype)
    return (hidden * m).sum(1) / np.maximum(m.sum(1), 1)


def l2_normalize(v: np.ndarray, eps: float = 1e-12) -> np.ndarray:
    return v / np.sqrt(np.maximum((v**2).sum(-1, keepdims=True), eps))


#: Token vectors that a worker remembers, some 300 bytes each, and tokens of a batch that are pooled at a time.
HASH_TOKENS, POOLED_TOKENS = 20_000, 1 << 16


class HashEncoder:
    """An encoder without weights: every token id has a fixed pseudo-random vector."""

    def __init__(self, dim: int = 8, skip: tuple[int, ...] = (0, 2)):
        self.dim, self.skip = dim, skip
        self._vectors: dict[int, np.ndarray] = {}

    def load(self) -> None:
        self._vectors = {}

    def _vector(self, token: int) -> np.ndarray:
        if (v := self._vectors.get(token)) is None:
            need = -(-self.dim // 8)
            raw = b"".join(hashlib.sha256(f"{token}#{i}".encode()).digest() for i in range(need))
            v = np.frombuffer(raw, "<u4")[: self.dim].astype(np.float64) / 2**31 - 1
            if len(self._vectors) < HASH_TOKENS:
                self._vectors[token] = v
        return v

    def encode(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        known, inverse = np.unique(ids, return_inverse=True)
        table = np.stack([self._vector(int(t)) for t in known])
        used, place = mask * ~np.isin(ids, self.skip), inverse.reshape(ids.shape)
        rows = max(1, POOLED_TOKENS // max(1, ids.shape[1]))
        pooled = [mean_pool(table[place[i : i + rows]], used[i : i + rows]) for i in range(0, len(ids), rows)]
        return l2_normalize(np.concatenate(pooled)).astype(np.float32)


def hash_vectors(texts: DataFrame, key: str, dim: int, column: str = "norm_text") -> DataFrame:
    """(key, v): the mean of all words' pseudo-embeddings, of unit length; an encoder in expressions only.

    Words become rows, so that every expression is compiled and a digest is computed once for
    its components; means are combined in each task before one row a key is shuffled.
    """
    words = texts.select(key, F.explode(F.split(column, " ")).alias("w"))
    means = words.groupBy(key).agg(*[F.avg(hash_component(F.col("w"), j)).alias(f"c{j}") for j in range(dim)])
    return means.select(key, unit_vector(F.array(*[F.col(f"c{j}") for j in range(dim)])).alias("v"))


class OnnxEncoder:
    """A model of a local folder, run by onnxruntime; pools if the model does not."""

    def __init__(self, folder: str, dim: int):
        self.folder, self.dim = folder, dim
        self._session = None

    def load(self) -> None:
        try:
            import onnxruntime
        except ImportError as e:
            raise ModelError("onnxruntime is not installed") from e
        path = os.path.join(self.folder, "model.onnx")
        if not os.path.exists(path):
            raise ModelError(f"no model.onnx in {self.folder}")
        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1  # tasks are the parallelism
        self._session = onnxruntime.InferenceSession(path, options, providers=["CPUExecutionProvider"])
        outputs = [o.name for o in self._session.get_outputs()]
        self._output = output_name(outputs)
        self._inputs = [i.name for i in self._session.get_inputs()]

    def encode(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        feed = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
        out = self._session.run([self._output], {k: v for k, v in feed.items() if k in self._inputs})[0]
        if out.ndim == 3:
            out = l2_normalize(mean_pool(out, mask))
        if out.shape != (len(ids), self.dim):
            raise InferenceError(f"vectors of shape {out.shape}, not {(len(ids), self.dim)}")
        return out.astype(np.float32)

    def __getstate__(self):
        return self.__dict__ | {"_session": None}


def output_name(names: list[str]) -> str:
    """Which output holds the vectors: a sentence embedding, the last hidden state, or the only one."""
    for name in ("sentence_embedding", "last_hidden_state"):
        if name in names:
            return name
    if len(names) == 1:
        return names[0]
    raise ModelError(f"which of the model's outputs holds the vectors? {', '.join(names)}")
