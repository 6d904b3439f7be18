"""``spark-submit`` entry: embed files of messages into a Parquet or NumPy file, or a folder's arrivals as a stream."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from .config import BATCH_SIZES, BUCKETS, EmbedConfig, parse_format, parse_sizes
from .errors import TextloomError
from .plans.engine import Engine
from .sources.sinks import write_vectors
from .sources.text import read_messages
from .streaming.embed import embed_stream, read_stream


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="textloom", description="Embed texts.")
    sub = p.add_subparsers(dest="command", required=True)
    e = sub.add_parser("embed", help="embed files")
    e.add_argument("--input", nargs="+", required=True)
    e.add_argument("--output", default="embeddings.npy")
    e.add_argument("--max-messages", type=int, default=0)
    e.add_argument("--skip-corrupt", action="store_true", help="go on where a file can't be read")
    e.add_argument("--quiet", action="store_true")
    w = sub.add_parser("stream", help="embed what arrives in a folder")
    w.add_argument("--input", required=True)
    w.add_argument("--output", required=True)
    w.add_argument("--state", required=True, help="folder of the stream's progress")
    w.add_argument("--batch-timeout-ms", type=int, default=0, help="longest wait before what has arrived is embedded; 0 takes what is there and ends")
    for one in (e, w):
        one.add_argument("--model", help="name or local folder; without one, a hash encoder")
        one.add_argument("--model-dir", default="/opt/textloom/models")
        one.add_argument("--format", default="jsonl")
        one.add_argument("--truncation", type=int, default=512)
        one.add_argument("--prefix", default="")
        one.add_argument("--tokenize-workers", type=int, default=8)
        one.add_argument("--dedup-capacity", type=int, default=0)
        one.add_argument("--buckets", type=parse_sizes, default=BUCKETS)
        one.add_argument("--batch-sizes", type=parse_sizes, default=BATCH_SIZES)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("textloom").getOrCreate()
    began = time.time()
    try:
        config = EmbedConfig(model=a.model, model_dir=a.model_dir, truncation=a.truncation, prefix=a.prefix, buckets=a.buckets, batch_sizes=a.batch_sizes, dedup_capacity=a.dedup_capacity, tokenize_workers=a.tokenize_workers)
        engine = Engine(config)
        if a.command == "stream":
            every = f"{a.batch_timeout_ms} milliseconds" if a.batch_timeout_ms > 0 else None
            embed_stream(read_stream(spark, a.input, parse_format(a.format), min_bytes=config.min_input_bytes), engine, a.output, a.state, every=every).awaitTermination()
            return 0
        messages = read_messages(spark, a.input, parse_format(a.format), min_bytes=config.min_input_bytes, limit=a.max_messages, corrupt="skip" if a.skip_corrupt else "error")
        result = engine.embed(messages)
        write_vectors(result.df, a.output, engine.hidden_dim)
        stats = result.stats()
        lost = result.missing(messages).count()
    except TextloomError as e:
        print(e, file=sys.stderr)
        return 2
    if not a.quiet:
        print(f"embedded {stats.messages_processed - stats.messages_failed}, skipped {stats.messages_skipped}, failed {stats.messages_failed}, {stats.throughput:.0f} a second, {time.time() - began:.1f} s")
    if config.telemetry:
        print(stats.to_json(), file=sys.stderr)
    if lost:
        print(f"{lost} messages have no result", file=sys.stderr)
    return 1 if stats.messages_failed or lost else 0


if __name__ == "__main__":
    sys.exit(main())
