"""Text streams to vectors: the batch plan on each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import Engine
from ..sources.text import parse_jsonl, parse_plain


def read_stream(spark: SparkSession, folder: str, fmt: str = "jsonl", *, min_bytes: int = 10) -> DataFrame:
    """(seq, id, text) of lines that arrive in a folder, plain or compressed.

    seq tells lines of one micro-batch apart.
    """
    lines = spark.readStream.option("lineSep", "\n").text(folder)
    parsed = (parse_jsonl if fmt == "jsonl" else parse_plain)(lines)
    good = parsed.where(F.col("ok") & (F.octet_length("text") >= min_bytes))
    return good.select("id", "text")


def embed_stream(messages: DataFrame, engine: Engine, out: str, checkpoint: str, *, every: str | None = None) -> StreamingQuery:
    """Append (id, status, embedding) to ``out``; ``every`` is a trigger interval, None takes what is there.

    Equal texts share work within a micro-batch. A batch that is run again replaces its own
    folder, so that rows are written once.
    """

    def write(df: DataFrame, number: int) -> None:
        rows = engine.plan(df.withColumn("seq", F.monotonically_increasing_id()))
        rows.select("id", "status", "embedding").write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()
