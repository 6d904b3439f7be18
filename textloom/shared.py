"""The folder that driver and executors share, and tables written there between stages."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_kept: list[tuple[weakref.ref, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's own folder.

    Where neither is set, a local master gets a temporary folder; on a cluster that is an
    error, as executors could not see it.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='textloom-')}"
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's process ends."""
    path = f"{shared_dir(spark)}/textloom-{uuid.uuid4().hex}/{name}"
    if not _kept:
        atexit.register(_remove_all)
    _kept.append((weakref.ref(spark), path))
    return path


def hadoop_path(spark: SparkSession, path: str):
    """(file system, Path) by which the JVM reaches ``path``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


def _remove_all() -> None:
    for ref, path in _kept:
        spark = ref()
        try:
            if spark is not None and spark.sparkContext._jsc is not None:
                remove(spark, path.rpartition("/")[0])
        except Exception:  # noqa: BLE001  the JVM may be gone already
            return


def store(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors. ``options`` are the writer's."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop(df: DataFrame) -> None:
    """Remove what ``store`` wrote, once nothing reads it any more."""
    remove(df.sparkSession, df._stored_at)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(scan: DataFrame, parts_per_core: int = 1) -> DataFrame:
    """``scan`` dealt over all cores where its files can't be split into as many parts.

    Small or compressed inputs arrive in few partitions; what follows is heavier than dealing
    them out. Large inputs have more parts than cores and are left as they are.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    parts = scan._jdf.queryExecution().toRdd().getNumPartitions()
    return scan if parts >= parts_per_core * cores else scan.repartition(cores)
