"""Sinks of embeddings: Parquet with ids, NumPy files without, and small result tables."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import pyarrow as pa
import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InputOutputError
from ..shared import hadoop_path, remove, work_dir


def write_parquet(results: DataFrame, path: str, *, single: bool = False) -> None:
    """(id, embedding) of embedded rows, in order of seq, zstd; rows without an id get their seq."""
    rows = results.where("status = 'ok'")
    rows = rows.coalesce(1).sortWithinPartitions("seq") if single else rows.orderBy("seq")
    ident = F.coalesce(F.nullif(F.col("id"), F.lit("")), F.col("seq").cast("string"))
    rows.select(ident.alias("id"), "embedding").write.mode("overwrite").option("compression", "zstd").parquet(path)


def npy_header(rows: int, dim: int) -> bytes:
    """The 128 bytes before the values of a version 1.0 file of float32 rows."""
    text = f"{{'descr': '<f4', 'fortran_order': False, 'shape': ({rows}, {dim}), }}".encode()
    return b"\x93NUMPY\x01\x00" + struct.pack("<H", 118) + text.ljust(117) + b"\n"


def write_npy(results: DataFrame, path: str, dim: int) -> int:
    """Vectors in order of seq as one NumPy file; returns the number of rows.

    Tasks write the values of their range of rows to the shared folder; the driver streams these
    parts behind the header through the file system, without holding them.
    """
    spark = results.sparkSession
    rows = results.where("status = 'ok'").select("seq", "embedding").repartitionByRange("seq").sortWithinPartitions("seq")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                values = b.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f4")
                if len(values) != b.num_rows * dim:
                    raise InputOutputError(f"a vector has not {dim} components")
                yield pa.RecordBatch.from_arrays([b.column(0).slice(0, 1), pa.array([b.num_rows]), pa.array([values.tobytes()])], names=["first", "n", "data"])

    folder = work_dir(spark, "npy")
    rows.mapInArrow(pack, "first long, n long, data binary").write.parquet(folder)
    parts = spark.read.parquet(folder).orderBy("first")
    total = parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    fs, target = hadoop_path(spark, path)
    out = fs.create(target, True)
    try:
        out.write(npy_header(total, dim))
        for r in parts.select("data").toLocalIterator():
            out.write(bytes(r.data))
    finally:
        out.close()
        remove(spark, folder)
    return total


#: Bytes of a NumPy file's values that one task reads.
NPY_SPLIT = 8 << 20


def read_npy(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """(at, found) of a file as ``write_npy`` writes it: rows by number, read by many tasks, each its own range of the file.

    The file system splits it into records of a fixed length that divides header and rows.
    """
    unit = math.gcd(128, 4 * dim)
    each, head = 4 * dim // unit, 128 // unit
    conf = {"fixedlengthinputformat.record.length": str(unit), "mapreduce.input.fileinputformat.split.maxsize": str(NPY_SPLIT)}
    lib = "org.apache.hadoop.mapreduce.lib.input.FixedLengthInputFormat"
    records = spark.sparkContext.newAPIHadoopFile(path, lib, "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf=conf)
    schema = T.StructType().add("place", "long").add("data", "binary")
    pieces = spark.createDataFrame(records.map(lambda r: (r[0] // unit - head, bytearray(r[1]))), schema, verifySchema=False).where("place >= 0")
    if each > 1:  # rows of several records are put together
        at = F.floor(F.col("place") / each).alias("place")
        pieces = pieces.groupBy(at).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.hex("data").alias("h")))), lambda x: x["h"]), "").alias("h")).select("place", F.unhex("h").alias("data"))

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = np.frombuffer(b"".join(b.column(1).to_pylist()), "<f4")
            found = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, dim, dtype=np.int32), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), found], names=["at", "found"])

    return pieces.mapInArrow(values, "at long, found array<float>")


def write_vectors(results: DataFrame, path: str, dim: int) -> None:
    """Parquet by the extension ``parquet``, else NumPy."""
    if path.endswith(".parquet"):
        write_parquet(results, path)
    else:
        write_npy(results, path, dim)


def preview(results: DataFrame) -> DataFrame:
    """(line): id, a tab, and the first three components to six decimals."""
    e = [F.format_string("%.6f", F.get("embedding", F.lit(i)).cast("double")) for i in range(3)]
    return results.where("status = 'ok'").select(F.concat_ws("\t", "id", F.concat_ws(" ", *e)).alias("line"))


def write_results(table: DataFrame, folder: str) -> None:
    """A small table as JSON and CSV."""
    table.coalesce(1).write.mode("overwrite").json(f"{folder}/json")
    table.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/csv")
