"""Settings of the embedding engine."""

from __future__ import annotations

import math
from dataclasses import dataclass

from .errors import ConfigError

#: Token lengths that batches are padded to, and rows of a batch of each.
BUCKETS = (24, 32, 40, 48, 56, 64, 80, 96, 128, 256)
BATCH_SIZES = (4096, 4096, 3072, 2048, 2048, 2048, 1536, 1536, 1024, 512)
SMALL_BUCKETS, SMALL_BATCH_SIZES = (32, 64, 128, 256), (4096, 2048, 2048, 512)


@dataclass(frozen=True)
class EmbedConfig:
    """Lengths are UTF-8 bytes, not characters. ``dedup_capacity`` above 0 embeds equal texts once."""

    model: str | None = None
    model_dir: str = "/opt/textloom/models"
    buckets: tuple[int, ...] = BUCKETS
    batch_sizes: tuple[int, ...] = BATCH_SIZES
    tokenize_workers: int = 8
    truncation: int = 256
    lowercase: bool = True
    min_bytes: int = 10
    min_input_bytes: int = 10
    prefix: str = "passage: "
    telemetry: bool = True
    dedup_capacity: int = 0
    dim: int = 8

    def __post_init__(self):
        if not self.buckets:
            raise ConfigError("buckets must not be empty")
        if len(self.buckets) != len(self.batch_sizes):
            raise ConfigError("buckets and batch_sizes must have the same length")
        if any(b <= 0 for b in self.batch_sizes):
            raise ConfigError("batch sizes must be positive")
        if self.buckets[0] <= 0 or any(a >= b for a, b in zip(self.buckets, self.buckets[1:])):
            raise ConfigError("buckets must increase strictly")
        if self.truncation <= 0:
            raise ConfigError("truncation must be positive")
        if self.tokenize_workers <= 0:
            raise ConfigError("tokenize_workers must be positive")

    def scaled(self, dim: int) -> tuple[int, ...]:
        """Batch sizes for vectors of ``dim`` components."""
        return tuple(autoscale(b, dim) for b in self.batch_sizes)


def autoscale(batch_size: int, dim: int) -> int:
    """Batches of wide models shrink in proportion to 768 components, to 64 rows at least."""
    return batch_size if dim <= 768 else max(64, math.ceil(batch_size * 768 / dim))


def hidden_dim(config: dict, default: int = 384) -> int:
    """Vector width that a model's config.json tells."""
    for key in ("hidden_size", "d_model"):
        if isinstance(config.get(key), int):
            return config[key]
    return default


def parse_format(text: str) -> str:
    if text not in ("jsonl", "plain"):
        raise ConfigError(f"unknown input format {text!r}; jsonl or plain")
    return text


def parse_sizes(text: str) -> tuple[int, ...]:
    """Comma-separated positive integers."""
    try:
        out = tuple(int(x) for x in text.split(",") if x.strip())
    except ValueError as e:
        raise ConfigError(f"not a list of numbers: {text!r}") from e
    if not out:
        raise ConfigError("an empty list of numbers")
    return out

