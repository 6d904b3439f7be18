"""Run statistics as DataFrames and as one record."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import shuffle_partitions, store


@dataclass(frozen=True)
class EmbedStats:
    messages_processed: int
    messages_skipped: int
    messages_failed: int
    batches_computed: int
    fill_ratio: float
    dedup_hits: int
    dedup_size: int
    per_bucket_batches: tuple[int, ...]
    per_bucket_messages: tuple[int, ...]
    per_partition_batches: tuple[int, ...]
    cache_hits: int
    cache_misses: int
    runtime_cache_hits: int
    hidden_dim: int
    elapsed_s: float

    @property
    def throughput(self) -> float:
        return self.messages_processed / max(self.elapsed_s, 1e-9)

    @property
    def cache_hit_rate(self) -> float:
        total = self.cache_hits + self.cache_misses
        return self.cache_hits / total if total else 0.0

    def to_json(self) -> str:
        record = asdict(self) | {"throughput": round(self.throughput, 1), "cache_hit_rate": round(self.cache_hit_rate, 4)}
        return json.dumps(record | {"fill_ratio": round(self.fill_ratio, 4), "elapsed_s": round(self.elapsed_s, 3)})


def latency_stats(df: DataFrame, column: str) -> DataFrame:
    """One row: n, min, p50, p95, p99, max and mean of ``column``; zeros where there are no rows.

    Percentiles are values at fixed indexes. Rows of equal value are counted first; the counts
    are range-partitioned and sorted, and partitions' sums, one number each, start the running
    count that finds the indexes, so that no task sees all values.
    """
    spark = df.sparkSession
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("x")).agg(F.count("*").alias("c"))
    ranged = counts.repartitionByRange(shuffle_partitions(spark), "x").withColumn("part", F.spark_partition_id())
    ranged = store(ranged, "counts")
    sums = {r.part: r.n for r in ranged.groupBy("part").agg(F.sum("c").alias("n")).collect()}
    parts = sorted(sums)
    before = spark.createDataFrame(list(zip(parts, accumulate([0, *(sums[p] for p in parts)]))), "part int, before long")  # one row a partition
    total = sum(sums.values())
    last = F.col("before") + F.sum("c").over(Window.partitionBy("part").orderBy("x")) - 1
    ranked = ranged.join(F.broadcast(before), "part").withColumn("last", last)
    first = F.col("last") - F.col("c") + 1
    at = {name: min(math.floor(total * q), total - 1) for name, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))}
    out = ranked.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"),
        F.min("x").alias("min"),
        *[F.max(F.when((first <= i) & (F.lit(i) <= F.col("last")), F.col("x"))).alias(name) for name, i in at.items()],
        F.max("x").alias("max"),
        (F.sum(F.col("x") * F.col("c")) / F.sum("c")).alias("mean"),
    )
    return out.na.fill(0.0)


def status_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count("*").alias("n"))


def speed_up(table: DataFrame, ours: str, theirs: str) -> DataFrame:
    """``table`` with the ratio of two throughput columns, two decimals."""
    return table.withColumn("speed_up", F.round(F.try_divide(ours, theirs), 2))
