"""The corpus pipeline: five stages, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and reread as the next
one's docs. All but the last return the columns of documents, extra ones included; the last says
where each row lies. Stages decide row by row: by a row's values, never by its id alone, so that
null and repeated ids, and rows equal in all columns, have defined results. Columns may have any
names but ``_metadata``. Null texts count as empty, very long ones are read whole, and an empty
table goes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import decontam, mixing, quality, sharding, simhash
from textloom.llm.common import store, work_dir
from textloom.shared import spread


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that fail the base rules or that little is left of without shared lines.

    Null and empty texts have no words and go. Rows of one text and host are judged alike; a line
    in exactly as many documents as the limit stays.
    """
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of linked texts.

    Links are op9_simhash's, then, among what they leave, those of texts whose five-word shingles
    overlap (Jaccard) by 0.8 or more. Null ids come last; of rows of one id, that of the smallest
    digest stays, of equal rows one. Texts without words are a group like any other.
    """
    return simhash.drop_near_duplicates(docs, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a window of a benchmark item.

    Texts without words are clean; an empty benchmark rejects nothing.
    """
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources come near their targets.

    Rows without words are taken 0 times; a null source is a source; equal rows are rounded one by one.
    """
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stores all rows in compacted shards; one row per stored row, with its id, null or not."""
    return sharding.shard(docs, work_dir(spark, "shards"))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing_sources),
    ("sharding", shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for i, (_, stage) in enumerate(STAGES):
        docs = store(stage(spark, docs, sf_dir), f"stage{i}")
    return docs


#: Fingerprints, random copies and shards are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None
