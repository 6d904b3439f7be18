"""Shards by size-tiered compaction under versioned manifests.

Arrivals are appended as small immutable Parquet shards. Shards of similar size form a tier; when
a tier below the target holds enough of them, they are merged into files of the target size. A
version is a small file that names lists of shards; a new version writes lists only for the runs
that it touches, and is renamed into place, which fails if another writer was first, so that
readers always see a whole version. The rename is exclusive where the file system makes it so
(HDFS, local disks); on an object store without a conditional put a single writer must commit.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hadoop_path, quoted, unused

#: Size of a merged shard.
TARGET_BYTES = 64 << 20
#: Rows of an arriving shard.
ARRIVAL_ROWS = 2048
#: Shards of a tier that start a merge.
FAN_IN = 4
#: Shards that one merging job reads: bounds its shuffle, its table of names, what the driver holds and what a failure repeats.
JOB_SHARDS = 50_000
#: Shards that one list names.
LIST_SHARDS = 10_000


class Conflict(RuntimeError):
    """Another writer committed this version first."""


@dataclass(frozen=True, order=True)
class Shard:
    run: str  # folder below data/
    file: str
    bytes: int
    rows: int
    merges: int = 0  # how often its rows have been rewritten


@dataclass(frozen=True)
class Listing:
    """A file that names shards of one run, with what a planner must know of them."""

    path: str  # below lists/
    run: str
    shards: int
    rows: int
    tiers: tuple[tuple[int, int], ...]  # (tier, how many shards below half the target)


@dataclass(frozen=True)
class Manifest:
    version: int
    lists: tuple[Listing, ...] = ()
    schema: str | None = None  # JSON of the rows' schema

    @property
    def n_shards(self) -> int:
        return sum(x.shards for x in self.lists)


def tier(size: int, fan_in: int = FAN_IN) -> int:
    """Shards within a factor of ``fan_in`` of one another, counted from 64 KB, share a tier."""
    return max(0, math.floor(math.log(max(1, size) / 65536, fan_in)))


def plan(shards: list[Shard], *, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN) -> list[list[Shard]]:
    """Groups of shards to merge, each into one file.

    Shards of half the target or more are done. Among the others every tier of at least
    ``fan_in`` shards is cut, by path, into groups that stay within the target; groups of one
    shard are left alone. Paths, not arrival times, give the order, so that plans agree.
    """
    tiers: dict[int, list[Shard]] = {}
    for s in sorted(shards):
        if 2 * s.bytes < target_bytes:
            tiers.setdefault(tier(s.bytes, fan_in), []).append(s)
    out = []
    for t in sorted(tiers):
        if len(tiers[t]) < fan_in:
            continue
        group, size = [], 0
        for s in tiers[t]:
            if group and size + s.bytes > target_bytes:
                out.append(group)
                group, size = [], 0
            group.append(s)
            size += s.bytes
        out.append(group)
    return [g for g in out if len(g) > 1]


class ShardStore:
    """A folder that driver and executors share, with ``data``, ``lists`` and ``manifests`` in it.

    ``target_bytes`` and ``fan_in`` hold for the whole store, as its lists count shards by tier.
    """

    def __init__(self, spark: SparkSession, root: str, *, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN):
        self.spark, self.root, self.target_bytes, self.fan_in = spark, root.rstrip("/"), target_bytes, fan_in

    # --- files ------------------------------------------------------------------------------

    def _fs(self, path: str):
        return hadoop_path(self.spark, f"{self.root}/{path}")

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs(folder)
        return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []

    def _text(self, path: str) -> str:
        fs, p = self._fs(path)
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, path: str, text: str) -> None:
        fs, p = self._fs(path)
        stream = fs.create(p, False)
        try:
            stream.write(text.encode())
        finally:
            stream.close()

    def _delete(self, paths: list[str]) -> None:
        def one(path: str) -> None:
            fs, p = self._fs(path)
            fs.delete(p, True)

        with ThreadPoolExecutor(16) as pool:
            list(pool.map(one, paths))

    # --- versions ---------------------------------------------------------------------------

    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self._names("manifests") if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest version, or ``version``; version 0 is the empty store."""
        version = max(self.versions(), default=0) if version is None else version
        if version == 0:
            return Manifest(0)
        x = json.loads(self._text(f"manifests/v{version:010d}.json"))
        lists = tuple(Listing(**{**one, "tiers": tuple(map(tuple, one["tiers"]))}) for one in x["lists"])
        return Manifest(x["version"], lists, x["schema"])

    def shards(self, lists: tuple[Listing, ...]) -> Iterator[Shard]:
        for one in lists:
            for line in self._text(f"lists/{one.path}").splitlines():
                yield Shard(**json.loads(line))

    def list_shards(self, shards: list[Shard]) -> list[Listing]:
        """Write lists of ``shards``, each of one run."""
        out = []
        runs: dict[str, list[Shard]] = {}
        for s in sorted(shards):
            runs.setdefault(s.run, []).append(s)
        for run, own in runs.items():
            for at in range(0, len(own), LIST_SHARDS):
                some = own[at : at + LIST_SHARDS]
                path = f"{uuid.uuid4().hex}.json"
                self._put(f"lists/{path}", "\n".join(json.dumps(asdict(s)) for s in some))
                tiers: dict[int, int] = {}
                for s in some:
                    if 2 * s.bytes < self.target_bytes:
                        t = tier(s.bytes, self.fan_in)
                        tiers[t] = tiers.get(t, 0) + 1
                out.append(Listing(path, run, len(some), sum(s.rows for s in some), tuple(sorted(tiers.items()))))
        return out

    def commit(self, base: Manifest, lists: list[Listing], schema: str | None) -> Manifest:
        """Make ``lists`` the version after ``base``; raises Conflict if that version exists."""
        new = Manifest(base.version + 1, tuple(lists), schema)
        temporary, final = f"manifests/.{uuid.uuid4().hex}", f"manifests/v{new.version:010d}.json"
        self._put(temporary, json.dumps({"version": new.version, "schema": schema, "lists": [asdict(x) for x in new.lists]}))
        fs, here = self._fs(temporary)
        _, there = self._fs(final)
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        options = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        options[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE  # never over an existing file
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(there).toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(fs.makeQualified(here), fs.makeQualified(there), options)
        except Exception as e:
            fs.delete(here, False)
            if fs.exists(there):
                raise Conflict(f"version {new.version} exists") from e
            raise
        return new

    # --- writers ----------------------------------------------------------------------------

    def _write(self, df: DataFrame, merges: int, **options) -> list[Shard]:
        run = uuid.uuid4().hex
        df.write.options(compression="zstd", **options).parquet(f"{self.root}/data/{run}")
        fs, folder = self._fs(f"data/{run}")
        sizes = {f.getPath().getName(): f.getLen() for f in fs.listStatus(folder) if f.getPath().getName().endswith(".parquet")}
        counts = self.spark.read.schema(df.schema).parquet(f"{self.root}/data/{run}").groupBy(F.col("_metadata.file_name").alias("f")).agg(F.count("*").alias("n")).collect() if sizes else []
        rows = {r.f: r.n for r in counts}  # one row a file of this run
        self._delete([f"data/{run}/{name}" for name in sizes.keys() - rows.keys()])  # without rows
        return [Shard(run, name, sizes[name], n, merges) for name, n in rows.items()]

    def append(self, df: DataFrame, *, rows: int = ARRIVAL_ROWS) -> Manifest:
        """Commit an arrival as shards of at most ``rows`` rows, as the tasks of ``df`` make them."""
        new = self.list_shards(self._write(df, 0, maxRecordsPerFile=rows))
        while True:
            base = self.manifest()
            try:
                return self.commit(base, [*base.lists, *new], df.schema.json())
            except Conflict:
                continue

    def _small(self, base: Manifest) -> tuple[list[Listing], list[Shard]]:
        """Lists that hold shards to merge, and those of their shards: about two jobs' worth at most."""
        lists, found = [], []
        for one in base.lists:
            if one.tiers and len(found) < 2 * JOB_SHARDS:
                lists.append(one)
                found += self.shards((one,))
        return lists, found

    def compact(self) -> Manifest:
        """Merge until no tier below the target is full; jobs of bounded size, each committed by itself.

        Raises Conflict where another compaction merged the same shards first; what this one wrote is removed.
        """
        while True:
            base = self.manifest()
            lists, small = self._small(base)
            groups = _job(plan(small, target_bytes=self.target_bytes, fan_in=self.fan_in))
            if not groups:
                return base
            gone = {s for g in groups for s in g}
            rows = self._read(base.schema, [f"data/{s.run}/{s.file}" for s in sorted(gone)])
            group = unused("group", rows)
            of = [(s.file, s.run, i) for i, g in enumerate(groups) for s in g]
            dealt = self._placed(rows, self.spark.createDataFrame(of, f"file string, run string, {group} int"), len(of))
            merged = self._write(dealt.repartitionById(len(groups), F.col(group)).drop(group), 1 + max(s.merges for s in gone))
            touched = {x.path for x in lists if x.run in {s.run for s in gone}}
            new = self.list_shards([s for x in lists if x.path in touched for s in self.shards((x,)) if s not in gone] + merged)
            while True:
                now = self.manifest()
                if not touched <= {x.path for x in now.lists}:
                    self._delete([*{f"data/{s.run}" for s in merged}, *(f"lists/{x.path}" for x in new)])
                    raise Conflict("another compaction merged the same shards")
                try:
                    self.commit(now, [x for x in now.lists if x.path not in touched] + new, base.schema)
                    break
                except Conflict:
                    continue

    def vacuum(self, *, keep: int = 1) -> None:
        """Remove what none of the newest ``keep`` versions names: manifests, lists, whole runs, shards of others.

        Runs and lists that no version names at all are those of writers that failed, or of one
        that has not committed yet: call this while no other writer is at work.
        """
        versions = self.versions()
        kept = [self.manifest(v) for v in versions[-keep:]]
        live = {x.path: x for m in kept for x in m.lists}
        runs: dict[str, int] = {}
        for x in live.values():
            runs[x.run] = runs.get(x.run, 0) + x.shards
        dead = [f"data/{r}" for r in self._names("data") if r not in runs]
        for run, n in runs.items():
            names = [f for f in self._names(f"data/{run}") if f.endswith(".parquet")]
            if len(names) > n:
                used = {s.file for s in self.shards(tuple(x for x in live.values() if x.run == run))}
                dead += [f"data/{run}/{f}" for f in names if f not in used]
        dead += [f"lists/{x}" for x in self._names("lists") if x.endswith(".json") and x not in live]
        self._delete(dead + [f"manifests/v{v:010d}.json" for v in versions[:-keep]])

    # --- readers ----------------------------------------------------------------------------

    def _read(self, schema: str, paths: list[str]) -> DataFrame:
        kind = T.StructType.fromJson(json.loads(schema))
        return self.spark.read.schema(kind).parquet(*[f"{self.root}/{p}" for p in paths]) if paths else self.spark.createDataFrame([], kind)

    def _listed(self, m: Manifest) -> DataFrame:
        """(run, file, bytes, rows, merges) of all shards of a version."""
        return self.spark.read.schema("run string, file string, bytes long, rows long, merges int").json([f"{self.root}/lists/{x.path}" for x in m.lists])

    def _placed(self, rows: DataFrame, table: DataFrame, n: int) -> DataFrame:
        """``rows`` as read from shards, joined to ``table`` (file, run, ...; ``n`` rows) by the file that each lies in."""
        file, run, its_file, its_run = (unused(x, rows) for x in ("file", "run", "its_file", "its_run"))
        named = table.withColumnsRenamed({"file": file, "run": run})
        own = rows.select("*", F.col("_metadata.file_name").alias(its_file), F.element_at(F.split("_metadata.file_path", "/"), -2).alias(its_run))
        here = (F.col(its_file) == F.col(file)) & (F.col(its_run) == F.col(run))
        return own.join(F.broadcast(named) if n <= JOB_SHARDS else named, here).drop(file, run, its_file, its_run)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        m = self.manifest(version)
        if m.schema is None:
            raise ValueError("the store is empty")
        # Folders, not files, are named, and rows of shards that the version does not list are left out.
        rows = self._read(m.schema, sorted({f"data/{x.run}" for x in m.lists}))
        return self._placed(rows, self._listed(m).select("file", "run"), m.n_shards) if m.lists else rows

    def placement(self, *columns: str, version: int | None = None) -> DataFrame:
        """``columns`` of every row with shard (run and file), shard_rows, shard_bytes, merges and version."""
        m = self.manifest(version)
        if m.schema is None:
            raise ValueError("the store is empty")
        rows = self._read(m.schema, sorted({f"data/{x.run}" for x in m.lists}))
        own = [unused(f"of_{c}", rows) for c in ("shard", "rows", "bytes", "merges")]
        if not m.lists:
            empty = [F.lit(None).cast(t).alias(c) for c, t in zip(own, ("string", "long", "long", "int"))]
            placed = rows.select("*", *empty)
        else:
            values = [F.concat_ws("/", "run", "file"), F.col("rows"), F.col("bytes"), F.col("merges")]
            placed = self._placed(rows, self._listed(m).select("file", "run", *[v.alias(c) for v, c in zip(values, own)]), m.n_shards)
        named = [F.col(c).alias(n) for c, n in zip(own, ("shard", "shard_rows", "shard_bytes", "merges"))]
        return placed.select(*[F.col(quoted(c)) for c in columns], *named, F.lit(m.version).cast("long").alias("version"))


def _job(groups: list[list[Shard]], most: int | None = None) -> list[list[Shard]]:
    """The first groups that hold ``most`` shards together, one group at least."""
    total = 0
    for i, g in enumerate(groups):
        total += len(g)
        if i and total > (JOB_SHARDS if most is None else most):
            return groups[:i]
    return groups


def shard(docs: DataFrame, root: str, *, id_col: str = "doc_id", arrival_rows: int = ARRIVAL_ROWS, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN) -> DataFrame:
    """Append ``docs`` to the store at ``root``, compact it, and say where each of its rows lies.

    All columns and rows are stored as they are: nulls, repeated rows, empty and very long texts,
    extra columns of any name but ``_metadata``. Ties in size are told by path. An empty table
    commits a version without shards. Returns the id column with shard, shard_rows, shard_bytes,
    merges, version. Versions before the last are removed.
    """
    store = ShardStore(docs.sparkSession, root, target_bytes=target_bytes, fan_in=fan_in)
    store.append(docs, rows=arrival_rows)
    store.compact()
    store.vacuum()
    return store.placement(id_col)
