"""A mounted folder walked by tasks, with links, hidden and empty files, and what could not be read as rows."""

from __future__ import annotations

import os
import re
import stat
import unicodedata
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import basename, file_id, root_identity
from ..scratch import kept, shared_dir
from ..session import safe_unions
from .files import finished, reusing
from .ignore import ignored

ENTRY = (
    "kind string, linked boolean, source_path string, canonical_path string, relative_path string, "
    "size long, modified_at_ns long, changed_at_ns long, device_id long, inode long, read_status string, last_error string"
)
NAMES = [part.split()[0] for part in ENTRY.split(", ")]
OUTSIDE = "a link that leads out of the root"
ROWS = 4096  # of a batch
MOST_BYTES = 64 << 20  # of a file that is read
BATCH_BYTES = 16 << 20
TASK_BYTES = 256 << 20


def within(root: str, path: str) -> bool:
    return path == root or path.startswith(root.rstrip("/") + "/")


def _entry(root: str, excluded: tuple[str, ...], folder: str, below: str, entry: os.DirEntry) -> tuple | None:
    """The row of one entry of a folder (its path, and its path below the root); None for what is no file or is left out."""
    path = os.path.join(folder, entry.name)
    shown = entry.name.encode("utf-8", "replace").decode()
    name = unicodedata.normalize("NFC", shown.replace("\\", "/"))
    relative = f"{below}/{name}" if below else name
    times: tuple = (None, None, None, None, None)
    row = lambda kind, linked, canonical, status, why: (kind, linked, path if shown == entry.name else os.path.join(folder, shown), canonical, relative, *times, status, why)
    if shown != entry.name:
        return row("failure", False, None, "unreadable", "a name that is not UTF-8")
    try:
        found = entry.stat(follow_symlinks=False)
        linked = stat.S_ISLNK(found.st_mode)
        canonical = os.path.realpath(path, strict=True)
        if linked:
            found = os.stat(canonical)
        times = found.st_size, found.st_mtime_ns, found.st_ctime_ns, found.st_dev, found.st_ino
        if not within(root, canonical):
            return row("failure", linked, None, "unsafe", OUTSIDE)
        if any(within(e, canonical) for e in excluded):
            return None
        if stat.S_ISDIR(found.st_mode):
            return row("folder", linked, canonical, "ready", None)
        return row("file", linked, canonical, "ready", None) if stat.S_ISREG(found.st_mode) else None
    except OSError as error:
        return row("failure", False, None, "unreadable", os.strerror(error.errno) if error.errno else "not readable")


def _lister(root: str, excluded: tuple[str, ...]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def rows(folder: str, below: str) -> Iterator[tuple]:
        try:
            with os.scandir(folder) as entries:
                yield from (r for r in (_entry(root, excluded, folder, below, e) for e in entries) if r is not None)
        except OSError as error:
            yield ("failure", False, folder, None, below or ".", None, None, None, None, None, "unreadable", os.strerror(error.errno) if error.errno else "not readable")

    def listing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: list[tuple] = []
        for batch in batches:
            for folder, below in zip(batch["source_path"], batch["relative_path"]):
                for row in rows(folder, below):
                    made.append(row)
                    if len(made) == ROWS:
                        yield _frame(made)
                        made = []
        yield _frame(made)

    return listing


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=NAMES, dtype=object)
    return frame.astype({n: "Int64" for n in ("size", "modified_at_ns", "changed_at_ns", "device_id", "inode")})


def walked(spark: SparkSession, root: str, ignore: list[str] | None = None, excluded: tuple[str, ...] = ()) -> DataFrame:
    """A row a file below root and a row an entry that cannot be followed (read_status `unsafe` or `unreadable`, last_error).

    root is a folder that every machine has mounted at one place. Folders are listed level by level, each by one task that holds
    4,096 entries at a time; what was found is written in the shared folder, so a lost executor repeats a task's folders at most.
    Hidden and empty files count. Ignored folders (see sources.ignore) are not entered, nor are those of `excluded` (paths).

    Links: one that leads out of the root is a failure and is not followed; one to a file within is that file under another path.
    Every folder is listed once, so circles end: by its own path if that can be reached without links, else by the least
    path of the links that lead to it. Paths below the root are in NFC; of files that so get one path the least by its source
    path is the file, the others are failures. Names that are not UTF-8 are failures. Devices, sockets and pipes are left out.
    """
    if re.match(r"^(?!file:)[A-Za-z][A-Za-z0-9+.-]+:", root):
        raise ValueError("a walk needs a mounted folder; sources.files.listed reads others")
    safe_unions(spark)
    top = os.path.realpath(re.sub(r"^file:/*(?=/)", "", root), strict=True)
    apart = tuple(os.path.realpath(e) for e in excluded)
    base = f"{shared_dir(spark)}/walk-{uuid.uuid4().hex}"
    level = spark.createDataFrame([(top, top, "")], "canonical_path string, source_path string, relative_path string")
    step, entered, tasks = 0, f"{base}/entered", int(spark.conf.get("spark.sql.shuffle.partitions"))
    while True:
        level = level.withColumn("step", F.lit(step))
        level.write.mode("append").parquet(entered)
        now = spark.read.schema(level.schema).parquet(entered).where(F.col("step") == step)
        listing = now.repartition(tasks, "source_path").mapInPandas(_lister(top, apart), ENTRY)
        path = F.when(F.col("kind") == "folder", F.concat("relative_path", F.lit("/"))).otherwise(F.col("relative_path"))
        listing.where(~ignored(path, ignore or [])).write.mode("append").parquet(f"{base}/found")
        found = spark.read.schema(ENTRY).parquet(f"{base}/found")
        been = spark.read.schema(level.schema).parquet(entered).select("canonical_path")
        left = found.where("kind = 'folder'").join(been, "canonical_path", "left_anti")
        least = F.min(F.struct("relative_path", "source_path"))
        fresh = kept(left.groupBy("canonical_path", "linked").agg(least.alias("at")), "folders")
        own = fresh.where("not linked")
        level = own if not own.isEmpty() else fresh
        if fresh.isEmpty():
            break
        level, step = level.select("canonical_path", "at.source_path", "at.relative_path"), step + 1
    return _named(found.where("kind != 'folder'"), top)


def _named(found: DataFrame, top: str) -> DataFrame:
    order = F.row_number().over(Window.partitionBy("relative_path").orderBy(F.col("kind") == "failure", "source_path"))
    again = (F.col("nth") > 1) & (F.col("kind") == "file")
    identity = root_identity(F.lit(top))
    # of rows with one path, files before failures, one stays under the path; the others are told by their source path
    rows = found.withColumn("nth", order).withColumns({
        "relative_path": F.when(F.col("nth") > 1, F.concat("relative_path", F.lit("\0"), "source_path")).otherwise(F.col("relative_path")),
        "read_status": F.when(again, "unsafe").otherwise(F.col("read_status")),
        "last_error": F.when(again, "another file has this path").otherwise(F.col("last_error")),
    })
    return rows.select(
        file_id(identity, F.col("relative_path")).alias("file_id"), identity.alias("root_identity"), "relative_path", F.coalesce("canonical_path", "source_path").alias("canonical_path"), basename(F.col("relative_path")).alias("filename"),
        F.coalesce("size", F.lit(0)).cast("long").alias("size"), (F.coalesce("modified_at_ns", F.lit(0)) / 1e6).alias("modified_at_ms"), "modified_at_ns", "changed_at_ns", "device_id", "inode", "read_status", "last_error",
    )


def _reader(root: str, most: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def opened(path: str, device: int, inode: int) -> tuple[bytes | None, str | None, str | None]:
        try:
            if not within(root, os.path.realpath(path, strict=True)):
                return None, "unsafe", OUTSIDE
            handle = os.open(path, os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK)
            with os.fdopen(handle, "rb") as file:
                found = os.fstat(file.fileno())
                if (found.st_dev, found.st_ino) != (device, inode) or not stat.S_ISREG(found.st_mode):
                    return None, "unsafe", "another file since it was listed"
                if found.st_size > most:
                    return None, "unreadable", f"larger than {most} bytes"
                data = file.read(most + 1)
            return (data, None, None) if len(data) <= most else (None, "unreadable", f"larger than {most} bytes")
        except OSError as error:
            return None, "unreadable", os.strerror(error.errno) if error.errno else "not readable"

    def reading(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made, held, first = [], 0, 0
            for place, at in enumerate(zip(batch["canonical_path"], batch["device_id"], batch["inode"]), 1):
                made.append(opened(*at))
                held += len(made[-1][0] or b"")
                if held >= BATCH_BYTES or place == len(batch):
                    yield batch.iloc[first:place].assign(**dict(zip(("content", "refused", "why"), zip(*made))))
                    made, held, first = [], 0, place

    return reading


def contents(files: DataFrame, root: str, most: int = MOST_BYTES) -> DataFrame:
    """The files of a walk with content, refused and why: read as they were listed, and from within root alone.

    Each path is resolved anew, opened without following a link, and must be the device and inode that were listed: a file put
    in its place meanwhile, or one larger than `most` bytes, gives no content but a status and a reason. Files are dealt out to
    tasks by number, as many as their bytes ask for; a task holds 16 MiB and one file more.
    """
    top = os.path.realpath(re.sub(r"^file:/*(?=/)", "", root), strict=True)
    spark, ready = files.sparkSession, files.where("read_status = 'ready'")
    size = ready.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // TASK_BYTES + 1)
    schema = f"{ready._jdf.schema().toDDL()}, content binary, refused string, why string"
    return ready.repartition(tasks, "file_id").mapInPandas(_reader(top, most), schema)


def walked_listing(spark: SparkSession, root: str, ignore: list[str] | None = None, known: DataFrame | None = None, excluded: tuple[str, ...] = (), most: int = MOST_BYTES) -> DataFrame:
    """Like sources.files.listed, from a walk: hidden and empty files, links, and a row with its reason for what was not read.

    Files of `known` with the same size and time are not opened, as in `listed`.
    """
    walk = kept(walked(spark, root, ignore, excluded), "walk")
    places, same = reusing(walk.where("read_status = 'ready'"), known)
    failed = walk.where("read_status != 'ready'").withColumns({"content": F.lit(None).cast("binary"), "refused": F.col("read_status"), "why": F.col("last_error")})
    read = contents(places, root, most).unionByName(failed).withColumn("content", F.coalesce("content", F.lit("").cast("binary")))
    rows, refused = finished(read), F.col("refused").isNotNull()
    told = {"read_status": F.when(refused, F.col("refused")).otherwise(F.col("read_status")), "last_error": F.when(refused, F.col("why")).otherwise(F.col("last_error"))}
    nothing = {c: F.when(~refused, F.col(c)) for c in ("text", "content_hash", "fingerprint_hash")}
    fresh = rows.withColumns(told | nothing).drop("refused", "why")
    return fresh if same is None else fresh.unionByName(same.select(*fresh.columns))
