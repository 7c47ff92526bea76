"""The tables of an index as a log of small commits: what changed is added, what it replaces is marked as gone."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import LAYOUT, TABLES, conformed, empty, placed


class CommitConflict(RuntimeError):
    """Another commit came in between; nothing of this one is seen."""


@dataclass(frozen=True)
class Snapshot:
    """A state of the store that stays the same while it is held, whatever is committed meanwhile."""

    store: SnapshotStore
    pointer: dict

    @property
    def name(self) -> str | None:
        return self.pointer["name"]

    @property
    def version(self) -> int:
        return self.pointer.get("version", 0)

    @property
    def settings(self) -> dict[str, object]:
        """The settings named by the last commit that named any."""
        return self.pointer.get("settings") or {}

    def segments(self, table: str) -> list[dict]:
        return self.pointer["tables"].get(table, [])

    def read(self, table: str) -> DataFrame:
        return self.scan(table).select(*empty(self.store.spark, table).columns)

    def scan(self, table: str) -> DataFrame:
        """The rows of a table with the column by which compacted segments are kept in folders, so that filters on it prune them.

        A row counts unless a later commit has marked its file as gone. Marks are few, and none after compaction.
        """
        spark, segments = self.store.spark, self.segments(table)
        shape = placed(empty(spark, table), table)
        if not segments:
            return shape
        schema = shape.withColumn("__at", F.lit(0).cast("long")).schema
        parts = []
        for foldered in (False, True):
            paths = [f"{self.store.root}/{s['folder']}/{table}" for s in segments if s["foldered"] is foldered]
            if not foldered and paths:
                parts.append(spark.read.schema(schema).parquet(*paths))
            parts += [spark.read.schema(schema).parquet(path) for path in (paths if foldered else [])]  # each with folders of its own
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        if marks := self.pointer.get("gone", {}).get(table):
            gone = spark.read.parquet(*[f"{self.store.root}/{folder}/{table}.gone" for folder in marks]).withColumnRenamed("file_id", "__file")
            rows = rows.join(gone, (F.col("file_id") == F.col("__file")) & (F.col("__gone_at") > F.col("__at")), "left_anti")
        return rows.select(*shape.columns)


class SnapshotStore:
    """Tables below a folder of any file system that Spark reaches.

    A commit writes a folder with the new rows of each table (a segment) and the ids of the files whose older rows are gone,
    then an entry of the log, `LOG/<version>`, which names the segments and marks of every table. The entry comes into being by
    one rename that fails if another commit has taken the version; a commit that breaks off before leaves no trace in the log.
    `CURRENT` is a copy of the newest entry, for a log that got lost; after it, the newest pending entry counts.

    `compact` rewrites tables as one segment without marks, sorted and in folders (see schema.LAYOUT); `vacuum` deletes what no
    kept entry names. Both run beside readers, who hold their snapshot.
    """

    def __init__(self, spark: SparkSession, root: str, tables: tuple[str, ...] = tuple(TABLES)):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), tables

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self, *parts: str) -> list:
        path, fs = self._path(*parts)
        return list(fs.listStatus(path)) if fs.exists(path) else []

    def _pointer(self) -> dict:
        log = [x.getPath() for x in self._listed("LOG") if x.getPath().getName().isdigit()]
        if log:
            path = max(log, key=lambda p: int(p.getName()))
        elif (current := self._path("CURRENT"))[1].exists(current[0]):
            path = current[0]
        else:
            pending = [x for x in self._listed() if x.getPath().getName().startswith("PENDING-") and x.getLen() > 0]
            if not pending:
                return {"name": None, "version": 0, "tables": {}, "gone": {}}
            path = max(pending, key=lambda x: x.getModificationTime()).getPath()
        return json.loads("".join(r.value for r in self.spark.read.text(path.toString()).collect()))  # a line

    def snapshot(self) -> Snapshot:
        return Snapshot(self, self._pointer())

    def current(self) -> str | None:
        """The name of the present snapshot; None before the first commit."""
        return self.snapshot().name

    def read(self, table: str) -> DataFrame:
        """A table as it is now. Who reads several that belong together takes them from one snapshot()."""
        return self.snapshot().read(table)

    def settings(self) -> dict[str, object]:
        return self.snapshot().settings

    def manifest(self) -> DataFrame:
        """files in the order of their paths' UTF-16 code units."""
        return self.read("files").orderBy(F.encode("relative_path", "UTF-16BE"))

    def of(self, table: str, ids: DataFrame, key: str = "file_id") -> DataFrame:
        """The rows of a table whose key is among ids (a column of that name; repeats count once); chunks by file and place."""
        found = self.read(table).join(ids.select(key), key, "left_semi")
        return found.orderBy("file_id", "ordinal") if table == "chunks" else found

    def _write(self, folder: str, table: str, rows: DataFrame, at: int, foldered: bool) -> dict:
        """A segment: few files for few rows; in folders only where a whole table is written."""
        rows = placed(conformed(rows, table), table).withColumn("__at", F.lit(at).cast("long"))
        column, order = LAYOUT.get(table, (None, ["file_id"]))
        if foldered and column:
            rows.repartitionByRange(column, *order).sortWithinPartitions(column, *order).write.partitionBy(column).parquet(f"{self.root}/{folder}/{table}")
        else:
            rows.hint("rebalance").sortWithinPartitions(*order).write.parquet(f"{self.root}/{folder}/{table}")
        return {"folder": folder, "at": at, "foldered": bool(foldered and column)}

    def commit(self, frames: dict[str, DataFrame], settings: dict[str, object] | None = None, base: Snapshot | None = None) -> str:
        """Replace whole tables by frames; tables not named stay where they are, unread and unwritten, as do settings not given."""
        base = base or self.snapshot()
        name, at = f"snapshot-{uuid.uuid4().hex}", base.version + 1
        tables, gone = dict(base.pointer["tables"]), dict(base.pointer.get("gone", {}))
        for table, frame in frames.items():
            tables[table] = [self._write(name, table, frame, at, True)]
            gone.pop(table, None)
        return self._entry(name, at, tables, gone, base.settings if settings is None else settings)

    def change(self, changes: dict[str, tuple[DataFrame | None, DataFrame | None]], settings: dict[str, object] | None = None, base: Snapshot | None = None) -> str:
        """Of each table named: mark rows of the files of the first frame (file_id) as gone, add the rows of the second.

        Only these are written. CommitConflict if `base` is no longer the present snapshot.
        """
        base = base or self.snapshot()
        name, at = f"snapshot-{uuid.uuid4().hex}", base.version + 1
        tables, gone = dict(base.pointer["tables"]), dict(base.pointer.get("gone", {}))
        for table, (files, rows) in changes.items():
            if files is not None and tables.get(table):
                files.select("file_id").distinct().withColumn("__gone_at", F.lit(at).cast("long")).hint("rebalance").write.parquet(f"{self.root}/{name}/{table}.gone")
                gone[table] = [*gone.get(table, []), name]
            if rows is not None:
                tables[table] = [*tables.get(table, []), self._write(name, table, rows, at, False)]
        return self._entry(name, at, tables, gone, base.settings if settings is None else settings)

    def compact(self, tables: tuple[str, ...] | None = None, segments: int = 2) -> str | None:
        """Rewrite the tables that have at least so many segments, or marks, as one segment each; None if there are none."""
        base = self.snapshot()
        split = lambda t: len(base.segments(t)) >= segments or base.pointer.get("gone", {}).get(t) or (t in LAYOUT and not all(s["foldered"] for s in base.segments(t)))
        due = [t for t in (tables or self.tables) if base.segments(t) and split(t)]
        return self.commit({t: base.read(t) for t in due}, base=base) if due else None

    def vacuum(self, keep: int = 1, grace_s: float = 86_400.0) -> int:
        """Delete segments that none of the newest `keep` log entries names, and older entries; the number of folders deleted.

        What is younger than `grace_s` stays: a commit may be under way, or a reader.
        """
        log = sorted((x for x in self._listed("LOG") if x.getPath().getName().isdigit()), key=lambda x: int(x.getPath().getName()))
        used: set[str] = set()
        for entry in log[-max(1, keep) :]:
            said = json.loads("".join(r.value for r in self.spark.read.text(entry.getPath().toString()).collect()))
            used |= {s["folder"] for segments in said["tables"].values() for s in segments} | {f for marks in said.get("gone", {}).values() for f in marks}
        before, deleted = (time.time() - grace_s) * 1000, 0
        for x in self._listed():
            name, old = x.getPath().getName(), x.getModificationTime() <= before
            if old and (name.startswith("snapshot-") and name not in used or name.startswith("PENDING-")):
                self._path()[1].delete(x.getPath(), True)
                deleted += name.startswith("snapshot-")
        for entry in log[: -max(1, keep)]:
            if entry.getModificationTime() <= before:
                self._path()[1].delete(entry.getPath(), False)
        return deleted

    def written_bytes(self, name: str) -> int:
        """Bytes that a commit wrote for its tables."""
        path, fs = self._path(name)
        return fs.getContentSummary(path).getLength() if fs.exists(path) else 0

    def _entry(self, name: str, version: int, tables: dict, gone: dict, settings: dict) -> str:
        pending, fs = self._path(f"PENDING-{uuid.uuid4().hex}")
        stream = fs.create(pending, True)
        stream.write(bytearray(json.dumps({"name": name, "version": version, "tables": tables, "gone": gone, "settings": settings}).encode()))
        stream.close()
        try:
            self._point(pending)
        except CommitConflict:
            fs.delete(pending, False)
            raise
        return name

    def _point(self, pending) -> None:
        """Make a pending entry the next one of the log, if that place is free, and copy it to CURRENT."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        entry = json.loads("".join(r.value for r in self.spark.read.text(pending.toString()).collect()))
        target, fs = self._path("LOG", f"{entry['version']:012d}")
        fs.mkdirs(target.getParent())
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.NONE
        try:
            files.rename(pending, target, how)
        except Py4JJavaError as failed:
            if "AlreadyExists" in str(failed.java_exception.getClass().getName()):
                raise CommitConflict(f"version {entry['version']} has been committed by another") from None
            raise
        copy, current = self._path(f"PENDING-{uuid.uuid4().hex}")[0], self._path("CURRENT")[0]
        stream = fs.create(copy, True)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        how[0] = rename.OVERWRITE
        files.rename(copy, current, how)
