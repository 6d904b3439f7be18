"""Progress of a run: counts and rates while it goes on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


class Monitor(StreamingQueryListener):
    """Tells every micro-batch's number, rows, rows a second and rows in all."""

    def __init__(self, tell: Callable[[str], None] = print):
        self.tell, self.total = tell, 0

    def onQueryStarted(self, event) -> None:
        self.tell(f"started {event.id}")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.total += p.numInputRows
        self.tell(f"batch {p.batchId}: {p.numInputRows} rows, {p.processedRowsPerSecond or 0:.0f} a second, {self.total} in all")

    def onQueryTerminated(self, event) -> None:
        self.tell(f"ended after {self.total} rows" + (f": {event.exception}" if event.exception else ""))


def watch(spark: SparkSession, tell: Callable[[str], None] = print) -> Monitor:
    monitor = Monitor(tell)
    spark.streams.addListener(monitor)
    return monitor


def observed(results: DataFrame, name: str = "embedding") -> tuple[DataFrame, Observation]:
    """``results`` whose next action also counts rows by status, without another pass."""
    seen = Observation(name)
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("ok", "skipped", "failed")]
    return results.observe(seen, F.count(F.lit(1)).alias("rows"), *counts), seen
