"""Tables laid out by a partition column (a day, a bucket), clustered by entity, and committed together.

A commit writes new files for the partitions it replaces, in a folder of its own, then one small manifest that names, for
every table, the folder of each partition. The manifest appears under its version's number in one rename: until then no
reader sees anything of the commit, after it all of it. A run that dies leaves files that no manifest names, and running
it again does the whole work. Readers keep the version they began with, since files are never changed in place.

Marks (a source's last applied batch, a reader's cursor, what is dirty) are part of the manifest, so they advance with the
rows that they speak of or not at all. A commit on an older base is applied on top of the newest version if nothing that
it replaces has changed meanwhile; else it is refused and can be made again.

The manifest holds one entry a partition and a mark a source; rows are read and written by Spark alone.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_NULL = "__HIVE_DEFAULT_PARTITION__"


class Conflict(RuntimeError):
    """Another commit has replaced a partition that this one was made from."""


@dataclass(frozen=True)
class Change:
    """New content of partitions: rows, the partition column, the order within files; also the partitions (as text) that end up empty if rows has none of them."""

    rows: DataFrame
    by: str
    cluster: tuple[str, ...]
    replaced: frozenset[str] = field(default_factory=frozenset)


@dataclass(frozen=True)
class Written:
    """A change whose files are there but not yet part of a version."""

    by: str
    schema: str
    folder: str
    parts: frozenset[str]
    replaced: frozenset[str]


class Snapshot:
    """One version of all tables."""

    def __init__(self, store: Store, version: int, manifest: dict):
        self.store, self.version, self.tables, self.marks = store, version, manifest["tables"], manifest["marks"]

    def read(self, table: str, like: DataFrame | str | None = None) -> DataFrame:
        """The table's rows; filters on its partition column leave the other partitions' files unread. A table that is not there yet is empty, with the columns of `like`."""
        spark, t = self.store.spark, self.tables.get(table)
        if t is None or not t["parts"]:
            schema = StructType.fromJson(json.loads(t["schema"])) if t else like if isinstance(like, str) else like.schema
            return spark.createDataFrame([], schema)
        base = f"{self.store.root}/data/{table}"
        paths = sorted(f"{base}/written={w}/{t['by']}={p}" for p, w in t["parts"].items())
        return spark.read.schema(StructType.fromJson(json.loads(t["schema"]))).option("basePath", base).parquet(*paths).drop("written")

    def part(self, table: str, values: set[str], like: DataFrame | str | None = None) -> DataFrame:
        """The rows of some partitions, named as text."""
        rows = self.read(table, like)
        by = self.tables[table]["by"] if table in self.tables else None
        if by is None:
            return rows
        kind = rows.schema[by].dataType.simpleString()
        return rows.where(F.col(by).isin([F.lit(v).cast(kind) for v in sorted(values)])) if values else rows.limit(0)


class Store:
    """Tables and versions under a folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self, path: str) -> list[str]:
        where = self._path(path)
        files = where.getFileSystem(self._conf)
        return [s.getPath().getName() for s in files.listStatus(where)] if files.exists(where) else []

    def _text(self, path: str) -> str:
        where = self._path(path)
        stream = where.getFileSystem(self._conf).open(where)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names(f"{self.root}/versions") if n.endswith(".json"))

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The newest version, or the one asked for; version 0 has no tables."""
        have = self.versions()
        n = (have[-1] if have else 0) if version is None else version
        return Snapshot(self, n, json.loads(self._text(f"{self.root}/versions/{n:012d}.json")) if n else {"tables": {}, "marks": {}})

    def write(self, table: str, change: Change) -> Written:
        """Writes a change's files; a day of many rows is split over several files, each in order."""
        folder = uuid.uuid4().hex
        out = change.rows.hint("rebalance", change.by).sortWithinPartitions(change.by, *change.cluster)
        path = f"{self.root}/data/{table}/written={folder}"
        out.write.partitionBy(change.by).parquet(path)
        parts = frozenset(n.split("=", 1)[1] for n in self._names(path) if n.startswith(f"{change.by}="))
        return Written(change.by, out.schema.json(), folder, parts, change.replaced)

    def written(self, table: str, w: Written) -> DataFrame:
        """The rows of a change before it is part of a version."""
        schema = StructType.fromJson(json.loads(w.schema))
        return self.spark.read.schema(schema).parquet(f"{self.root}/data/{table}/written={w.folder}") if w.parts else self.spark.createDataFrame([], schema)

    def scratch(self, rows: DataFrame) -> DataFrame:
        """rows written once, for a writer that reads them several times; cleared by `clear_scratch`."""
        path = f"{self.root}/scratch/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def clear_scratch(self) -> None:
        where = self._path(f"{self.root}/scratch")
        where.getFileSystem(self._conf).delete(where, True)

    def publish(self, changes: dict[str, Written], base: Snapshot, marks: Callable[[dict], dict] = dict) -> Snapshot:
        """Makes written changes one new version; marks gives the new marks from the newest version's. Conflict if a replaced partition is no longer that of the base."""
        while True:
            head = self.snapshot()
            tables = dict(head.tables)
            for name, w in changes.items():
                now, then = head.tables.get(name, {"parts": {}})["parts"], base.tables.get(name, {"parts": {}})["parts"]
                gone = w.parts | w.replaced
                if any(now.get(p) != then.get(p) for p in gone):
                    raise Conflict(f"{name} has changed since version {base.version}")
                tables[name] = {"by": w.by, "schema": w.schema, "parts": {p: f for p, f in now.items() if p not in gone} | dict.fromkeys(w.parts, w.folder)}
            if self._put(head.version + 1, {"tables": tables, "marks": marks(dict(head.marks))}):
                return self.snapshot(head.version + 1)

    def commit(self, changes: dict[str, Change], base: Snapshot | None = None, marks: Callable[[dict], dict] = dict) -> Snapshot:
        """Writes and publishes changes of one or more tables; seen all together or not at all."""
        base = base or self.snapshot()
        return self.publish({name: self.write(name, c) for name, c in changes.items()}, base, marks)

    def _put(self, version: int, manifest: dict) -> bool:
        """Whether this version's manifest could be placed; False if another writer was first."""
        fs, folder = self._jvm.org.apache.hadoop.fs, f"{self.root}/versions"
        temporary, final = self._path(f"{folder}/.{uuid.uuid4().hex}"), self._path(f"{folder}/{version:012d}.json")
        files = final.getFileSystem(self._conf)
        files.mkdirs(final.getParent())
        stream = files.create(temporary, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        context = fs.FileContext.getFileContext(files.getUri(), self._conf)
        try:
            context.rename(files.makeQualified(temporary), files.makeQualified(final), self.spark.sparkContext._gateway.new_array(fs.Options.Rename, 0))
        except Exception as e:
            files.delete(temporary, False)
            if files.exists(final):
                return False
            raise e
        return True

    def export(self, to: str, version: int | None = None) -> DataFrame:
        """A consistent copy of one version under `to`, and table, version, n_rows, n_files, n_bytes of it, which is written beside it last."""
        snap = self.snapshot(version)
        about = None
        for name, t in sorted(snap.tables.items()):
            snap.read(name).hint("rebalance", t["by"]).write.partitionBy(t["by"]).parquet(f"{to}/{name}")
            copy = self.spark.read.parquet(f"{to}/{name}").select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("b"))
            each = copy.groupBy("f").agg(F.count("*").alias("n"), F.first("b").alias("b"))
            one = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_files"), F.coalesce(F.sum("b"), F.lit(0)).alias("n_bytes")).select(F.lit(name).alias("table"), F.lit(snap.version).alias("version"), "*")
            about = one if about is None else about.union(one)
        about.write.parquet(f"{to}/_about")
        return self.spark.read.parquet(f"{to}/_about")

    def vacuum(self, keep: int = 1) -> int:
        """Deletes all but the newest `keep` versions and the files that none of those names; how many folders went. Not beside running writers."""
        have = self.versions()
        keep_from = have[-keep:] if keep else []
        named = {(name, f) for v in keep_from for name, t in self.snapshot(v).tables.items() for f in t["parts"].values()}
        files, gone = self._path(self.root).getFileSystem(self._conf), 0
        for v in have[: -keep or None]:
            files.delete(self._path(f"{self.root}/versions/{v:012d}.json"), False)
        for table in self._names(f"{self.root}/data"):
            for folder in self._names(f"{self.root}/data/{table}"):
                if (table, folder.removeprefix("written=")) not in named:
                    files.delete(self._path(f"{self.root}/data/{table}/{folder}"), True)
                    gone += 1
        return gone
