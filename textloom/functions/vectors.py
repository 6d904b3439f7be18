"""Native vector and token expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def l2_normalize(vector: Column, eps: float = 1e-12) -> Column:
    """``vector`` over its length; ``eps`` bounds the squared length from below."""
    squares = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.get(F.transform(F.array(F.sqrt(F.greatest(squares, F.lit(eps)))), lambda n: F.transform(vector, lambda x: x.cast("double") / n)), F.lit(0))


def mean_pool(vectors: Column, mask: Column, dim: int) -> Column:
    """Sums of the masked vectors over the mask's sum, 1 at least."""
    kept = F.arrays_zip(vectors.alias("v"), mask.alias("m"))
    zero = F.array_repeat(F.lit(0.0), dim)
    total = F.aggregate(kept, zero, lambda a, x: F.zip_with(a, x["v"], lambda p, q: p + q.cast("double") * x["m"]))
    n = F.greatest(F.aggregate(mask, F.lit(0.0), lambda a, x: a + x), F.lit(1.0))
    return F.transform(total, lambda x: x / n)


def hash_component(word: Column, j: int) -> Column:
    """Component ``j`` of a word's pseudo-embedding, from -1 to 1; a digest serves five of them."""
    digest = F.md5(F.concat(word, F.lit(f"#{j // 5}")).cast("binary"))
    return F.conv(F.substring(digest, 6 * (j % 5) + 1, 6), 16, 10).cast("double") / F.lit(16777215.0) * 2 - 1


def bucket_of(length: Column, buckets) -> Column:
    """Number of the first bucket that holds ``length`` tokens, else the last."""
    out = F.lit(len(buckets) - 1)
    for i in range(len(buckets) - 2, -1, -1):
        out = F.when(length <= buckets[i], i).otherwise(out)
    return out


def by_bucket(bucket: Column, values) -> Column:
    """The value of a bucket's number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), bucket + 1)


def pad(ids: Column, length: Column) -> Column:
    """``ids`` cut or filled with zeros to ``length``."""
    return F.concat(F.slice(ids, F.lit(1), length), F.array_repeat(F.lit(0).cast("int"), F.greatest(length - F.size(ids), F.lit(0))))


def mask(ids: Column, length: Column) -> Column:
    n = F.least(F.size(ids), length)
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), length - n))


def with_specials(pieces: Column, max_len: int, cls: int = 0, sep: int = 2) -> Column:
    """Ids of all words in a row, between ``cls`` and ``sep``, ``max_len`` at most; a word may be cut."""
    return F.concat(F.array(F.lit(cls)), F.slice(F.flatten(pieces), F.lit(1), F.lit(max_len - 2)), F.array(F.lit(sep)))
