"""Buckets of similar token length, batches of bounded size, and how well they are filled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import bucket_of, by_bucket, mask, pad
from ..sources.text import dense_seq


def with_batches(df: DataFrame, length: str, order: str, buckets, batch_sizes) -> DataFrame:
    """``df`` with bucket, batch and place: rows of a bucket in turns of the bucket's batch size.

    Rows are numbered in their bucket by a sort over many tasks, as one bucket may hold most of them.
    """
    numbered = dense_seq(df.withColumn("bucket", bucket_of(F.col(length), buckets)), order, name="place", by=("bucket",))
    size = by_bucket(F.col("bucket"), batch_sizes)
    return numbered.withColumns({"batch": F.floor(F.col("place") / size), "place": F.col("place") % size})


def batch_table(batched: DataFrame, batch_sizes) -> DataFrame:
    """(bucket, batch, n_real, batch_size): one row for each batch."""
    return batched.groupBy("bucket", "batch").agg(F.count("*").alias("n_real")).withColumn("batch_size", by_bucket(F.col("bucket"), batch_sizes))


def fill(batches: DataFrame) -> DataFrame:
    """One row: batches, n_real, capacity and fill_ratio."""
    return batches.agg(F.count("*").alias("batches"), F.sum("n_real").alias("n_real"), F.sum("batch_size").alias("capacity")).withColumn("fill_ratio", F.coalesce(F.try_divide("n_real", "capacity"), F.lit(0.0)))


def padded(df: DataFrame, ids: str, buckets) -> DataFrame:
    """``df`` with bucket, padded ids and attention mask of the bucket's length."""
    df = df.withColumn("bucket", bucket_of(F.size(ids), buckets))
    n = by_bucket(F.col("bucket"), buckets)
    return df.withColumns({"padded": pad(F.col(ids), n), "mask": mask(F.col(ids), n)})
