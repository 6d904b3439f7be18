"""Work shared by equal texts: exact, by a join on the text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import store


def fnv1a(data: bytes) -> int:
    """64-bit FNV-1a."""
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def distinct_texts(df: DataFrame, text: str, *, nulls: bool = True) -> DataFrame:
    """(text, n): every text once with its number of rows; ``nulls`` says that null texts may occur."""
    rows = df.groupBy(text).agg(F.count("*").alias("n"))
    return rows.where(F.col(text).isNotNull()) if nulls else rows


def once_per_text(df: DataFrame, text: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``df`` joined with what ``work`` makes of its distinct texts (text, ...); null texts get nulls.

    ``df`` is stored first, so that what its texts come from is done once. Counts are combined before the shuffle; a text that holds most rows is split by Spark's
    skewed-join handling, as its own row on the other side is one.
    """
    rows = store(df, "texts")
    done = work(distinct_texts(rows, text).select(text))
    return rows.join(done, text, "left")


def stats(df: DataFrame, text: str, *, nulls: bool = True) -> DataFrame:
    """One row: rows with a text, distinct texts, and the rows that shared another's work."""
    return distinct_texts(df, text, nulls=nulls).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("dedup_size")).withColumn("dedup_hits", F.col("rows") - F.col("dedup_size"))
