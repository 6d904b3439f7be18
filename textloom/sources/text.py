"""Line-oriented corpora as DataFrames: file lists, JSONL and plain text, dense row numbers."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InputOutputError
from ..functions.normalize import once
from ..shared import hadoop_path, shuffle_partitions, store

#: Rows that may pass through one task.
TAKEN_ROWS = 100_000
#: Unicode white space at both ends, as ``trim`` below removes it.
_ENDS = r"(?U)^\s+|\s+$"


def resolve_inputs(spark: SparkSession, paths: list[str], *, missing: str = "error") -> list[str]:
    """Files of ``paths``, folders searched in depth, sorted, each once; hidden files are not inputs.

    ``missing`` is ``error`` or ``ignore``.
    """
    out = set()
    for path in paths:
        fs, p = hadoop_path(spark, path)
        if not fs.exists(p):
            if missing == "error":
                raise InputOutputError(f"no such file or folder: {path}")
            continue
        found = fs.listFiles(p, True)
        while found.hasNext():
            f = found.next().getPath()
            if not f.getName().startswith((".", "_")):
                out.add(f.toString())
    return sorted(out)


def trim(text: Column) -> Column:
    return F.regexp_replace(text, _ENDS, "")


def read_lines(spark: SparkSession, paths: list[str], *, missing: str = "error", corrupt: str = "error") -> DataFrame:
    """(file, block, value): lines of plain, gzip and zstd files, cut at newlines only.

    Compressed files can't be split; deal their rows out again before heavy work. ``corrupt`` is
    ``error`` or ``skip``: files that can't be read give the lines before the fault.
    """
    files = resolve_inputs(spark, paths, missing=missing)
    if not files:
        return spark.createDataFrame([], "file string, block long, value string")
    lines = spark.read.option("lineSep", "\n").option("ignoreCorruptFiles", str(corrupt == "skip").lower()).text(files)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def json_string(parsed: Column, key: str) -> Column:
    """A top-level string of a parsed JSON line; null for other types. The last of equal keys counts."""
    return once(F.try_variant_get(parsed, f"$.{key}", "variant"), lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))


def parse_jsonl(lines: DataFrame, value: str = "value") -> DataFrame:
    """``lines`` with id, text and ok: text is a trimmed, non-empty JSON string, or the line is malformed.

    An id of another type than string is empty. Blank lines are neither rows nor malformed; lines
    that are no UTF-8 are. Equal keys are allowed, for which a setting of the session is needed.
    """
    lines.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    text = lambda v: once(trim(json_string(v, "text")), lambda t: F.when(t != "", t))
    fields = once(F.try_parse_json(F.col(value)), lambda v: F.struct(F.coalesce(json_string(v, "id"), F.lit("")).alias("id"), text(v).alias("text")))
    # Exploded from an array of one, so that a line is parsed once and not again in filters that are pushed below.
    rows = lines.where(F.rlike(F.col(value), F.lit(r"(?U)\S"))).select("*", F.explode(F.array(fields)).alias("__fields"))
    out = rows.withColumns({"id": F.col("__fields.id"), "text": F.col("__fields.text")}).drop("__fields")
    return out.withColumn("ok", F.col("text").isNotNull() & F.is_valid_utf8(F.col(value)))


def parse_plain(lines: DataFrame, value: str = "value") -> DataFrame:
    """``lines`` with id, text and ok: trimmed lines that are not blank, not ok where they are no UTF-8; ids are given by ``dense_seq``."""
    return lines.withColumns({"id": F.lit(""), "text": trim(F.col(value)), "ok": F.is_valid_utf8(F.col(value))}).where("text != ''")


def _numbered(df: DataFrame, name: str, by: tuple[str, ...]) -> DataFrame:
    """``df`` stored with 0, 1, 2, ... in the order in which its partitions and their rows lie, from 0 for each value of ``by``.

    Rows of equal ``by`` must lie together. Partitions' row counts, one number for each value of
    ``by``, give the offsets, so that no task sees all rows.
    """
    spark = df.sparkSession
    numbered = store(df.withColumn("__id", F.monotonically_increasing_id()).select("*", F.shiftright("__id", 33).alias("__part"), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)).alias("__at")).drop("__id"), "numbered")
    counted = numbered.groupBy("__part", *by).agg(F.count("*").alias("__n"), F.min("__at").alias("__first")).collect()
    rows, seen = [], {}
    for r in sorted(counted, key=lambda r: (r["__part"], r["__first"])):
        group = tuple(r[c] for c in by)
        rows.append((r["__part"], *group, seen.get(group, 0) - r["__first"]))
        seen[group] = seen.get(group, 0) + r["__n"]
    kinds = [numbered.schema["__part"], *(numbered.schema[c] for c in by)]
    table = F.broadcast(spark.createDataFrame(rows, T.StructType([*(T.StructField(f.name, f.dataType) for f in kinds), T.StructField("__offset", T.LongType())])))
    return numbered.join(table, ["__part", *by]).withColumn(name, F.col("__offset") + F.col("__at")).select(*df.columns, name)


def dense_seq(df: DataFrame, *order: str, name: str = "seq", by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with 0, 1, 2, ... in the order of ``order`` columns, without one task for all rows.

    With ``by`` (few, non-null values) every value of these columns is numbered by itself. Rows
    are range-partitioned and sorted; partitions' counts give the offsets. Sorted rows are
    stored in between, so that both steps see the same partitions. Ranges are told from a sample,
    for which ``df`` is made once more: what is dear to make should be stored.
    """
    return _numbered(df.repartitionByRange(shuffle_partitions(df.sparkSession), *by, *order).sortWithinPartitions(*by, *order), name, by)


def first_of(df: DataFrame, most: int, *order: str) -> DataFrame:
    """The first ``most`` rows of ``df`` by ``order``; without it, in the order in which they lie.

    Few rows come from a heap in every task; many are numbered, so that no task holds them all.
    """
    if order and most <= TAKEN_ROWS:
        return df.orderBy(*order).limit(most)
    numbered = dense_seq(df, *order, name="__seq") if order else _numbered(df, "__seq", ())
    return numbered.where(F.col("__seq") < most).drop("__seq")


def read_messages(spark: SparkSession, paths: list[str], fmt: str = "jsonl", *, min_bytes: int = 10, limit: int = 0, corrupt: str = "error") -> DataFrame:
    """(seq, id, text) of accepted lines, in the order of files and lines; counts go to ``input_stats``.

    Texts of fewer than ``min_bytes`` bytes are left out before they get a number. The id of a
    plain line is its number. ``limit`` above 0 keeps the first rows only.
    """
    lines = read_lines(spark, paths, corrupt=corrupt).withColumn("line", F.monotonically_increasing_id())
    parsed = (parse_jsonl if fmt == "jsonl" else parse_plain)(lines)
    good = parsed.where(F.col("ok") & (F.octet_length("text") >= min_bytes)).select("file", "block", "line", "id", "text")
    order = ("file", "block", "line")
    out = dense_seq(first_of(good, limit, *order) if limit else good, *order)
    return out.select("seq", F.when(F.lit(fmt == "plain"), F.col("seq").cast("string")).otherwise(F.col("id")).alias("id"), "text")


def input_stats(parsed: DataFrame, min_bytes: int = 10) -> DataFrame:
    """One row: lines, malformed, short and accepted, of what ``parse_jsonl`` or ``parse_plain`` gave."""
    long = F.octet_length("text") >= min_bytes
    return parsed.agg(F.count("*").alias("lines"), F.count_if(~F.col("ok")).alias("malformed"), F.count_if(F.col("ok") & ~long).alias("short"), F.count_if(F.col("ok") & long).alias("accepted"))


def validate_jsonl(lines: DataFrame) -> int:
    """Number of rows; the first malformed line, or no row at all, is an error."""
    parsed = parse_jsonl(lines)
    bad = parsed.where(~F.col("ok")).select("file", "value").orderBy("file").limit(1).collect()
    if bad:
        raise InputOutputError(f"malformed line in {bad[0].file}: {bad[0].value[:80]!r}")
    n = parsed.count()
    if not n:
        raise InputOutputError("no rows")
    return n


def count_lines(spark: SparkSession, paths: list[str]) -> int:
    return read_lines(spark, paths).count()


def first_rows(spark: SparkSession, path: str, most: int, folder: str) -> str:
    """A file of the first ``most`` lines of ``path`` that are not blank, made once for each state of ``path``."""
    fs, p = hadoop_path(spark, path)
    if not fs.exists(p):
        raise InputOutputError(f"no such file: {path}")
    state = fs.getFileStatus(p)
    key = hashlib.sha1(f"{path}:{state.getModificationTime()}:{state.getLen()}:{most}".encode()).hexdigest()[:10]
    out = f"{folder.rstrip('/')}/first-{most}-{key}"
    if not fs.exists(hadoop_path(spark, f"{out}/_SUCCESS")[1]):
        lines = read_lines(spark, [path]).where(trim(F.col("value")) != "").withColumn("line", F.monotonically_increasing_id())
        lines.orderBy("file", "block", "line").limit(most).select("value").write.mode("overwrite").text(out)
    return out


def passages(texts: DataFrame, column: str, *, low: int = 50, high: int = 256, prefix: str = "passage: ") -> DataFrame:
    """(text): trimmed texts of ``low`` to ``high`` characters, prefixed."""
    return texts.select(trim(F.col(column)).alias("text")).where(F.length("text").between(low, high)).select(F.concat(F.lit(prefix), "text").alias("text"))


def with_title(title: Column, text: Column) -> Column:
    """``title. text``, or ``text`` where there is no title."""
    return F.when(F.coalesce(title, F.lit("")) != "", F.concat_ws(". ", title, text)).otherwise(text)


def posts(df: DataFrame, column: str, *, low: int = 10, most: int | None = None) -> DataFrame:
    """(text): trimmed texts of ``low`` characters or more; the first ``most`` of them if that is given."""
    found = df.select(trim(F.col(column)).alias("text")).where(F.length("text") >= low)
    return found if most is None else first_of(found, most)


def renamed_corpus(df: DataFrame, id_col: str = "docid") -> DataFrame:
    return df.select(F.col(id_col).alias("id"), "text")
