"""Directories as tables of files: listing, fingerprints, inspection and decoding, all by Spark's own readers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename, extension, file_id, format_of, mime_of, root_identity
from ..scratch import kept
from .ignore import ignored

SAMPLE = 8192


def control_share(sample: Column) -> Column:
    """The part of a binary sample's bytes that are control characters other than tab, line feed, form feed and carriage return."""
    hexed = F.regexp_replace(F.hex(sample), "(..)", "$1 ")
    return F.regexp_count(hexed, F.lit("(0[0-8B]|0[EF]|1.|7F) ")) / F.greatest(F.octet_length(sample), F.lit(1))


def inspected(files: DataFrame) -> DataFrame:
    """files (content, filename) with format, mime_family, read_status and last_error as their bytes say."""
    ext = extension(F.col("filename"))
    sample = F.substring("content", 1, SAMPLE)
    known = format_of(ext)
    broken = ~F.is_valid_utf8(F.col("content").cast("string"))
    null_byte = F.contains(F.hex(sample), F.lit("00")) & F.regexp_replace(F.hex(sample), "(..)", "$1 ").rlike("(^| )00 ")
    odd = known.isNull() & (control_share(sample) > 0.1)
    status = F.when(broken, "malformed").when(null_byte | odd, "unsupported").otherwise("ready")
    error = F.when(broken, "not valid UTF-8").when(null_byte, "holds a NUL byte").when(odd, "looks like binary data")
    return files.withColumns({"extension": ext, "format": F.coalesce(known, F.lit("text")), "mime_family": mime_of(ext, "text/plain"), "read_status": status, "last_error": error})


def exact_time(modified_at_ms: Column) -> Column:
    """Whether a file's time is finer than whole seconds, so that a later edit of the same size would show."""
    return F.pmod(modified_at_ms, F.lit(1000.0)) != 0


def _located(found: DataFrame, top: str, ignore: list[str]) -> DataFrame:
    """found (of binaryFile) with identities and times, without ignored paths; its other columns stay."""
    path = F.regexp_replace("path", r"^[a-z0-9]+:/*(?=/)", "")
    bare = "/" + top.split("://")[-1].removeprefix("file:").lstrip("/")
    rows = found.withColumn("relative_path", F.substring(path, len(bare) + 2, 1 << 20)).where(~ignored(F.col("relative_path"), ignore))
    identity = root_identity(F.lit(bare))
    return rows.select(
        file_id(identity, F.col("relative_path")).alias("file_id"), identity.alias("root_identity"), "relative_path", F.col("path").alias("canonical_path"), basename(F.col("relative_path")).alias("filename"),
        F.col("length").alias("size"), (F.unix_micros("modificationTime") / 1000.0).alias("modified_at_ms"), *[c for c in found.columns if c == "content"],
    )


#: Up to so many changed files are opened by name; more by one listing of the folder.
BY_NAME = 10_000


def listed(spark: SparkSession, root: str, ignore: list[str] | None = None, known: DataFrame | None = None) -> DataFrame:
    """A row a file below root: identities, fingerprint, format, status and text (null unless it is ready).

    Ignored paths are dropped before contents are read; contents are hashed where they are read. A file of `known` (see
    Indexer.known) whose size and time are the same, the time finer than a second, keeps its hashes unread and has no text: only
    the others are opened, by name where they are few.
    """
    top = root.rstrip("/")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    found = reader.load(top)
    if known is None:
        return finished(_located(found, top, ignore or []))
    places, same = reusing(_located(found.drop("content"), top, ignore or []), known)
    names = [r.canonical_path for r in places.select("canonical_path").limit(BY_NAME + 1).collect()]
    if not names:
        return same.select(*finished(_located(found, top, ignore or [])).columns)
    if len(names) <= BY_NAME:
        opened = reader.load([re.sub(r"([\\*?\[\]{}])", r"\\\1", name) for name in names])
    else:
        opened = found.join(places.select(F.col("canonical_path").alias("path")), "path", "left_semi")
    fresh = finished(_located(opened, top, ignore or []))
    return fresh.unionByName(same.select(*fresh.columns))


def reusing(places: DataFrame, known: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """The files of a listing that must be opened, and those that keep the hashes of `known` (None without it)."""
    if known is None:
        return places, None
    held = known.select("file_id", "size", "modified_at_ms", "content_hash", "fingerprint_hash", "format", "mime_family", F.lit(True).alias("held"))
    both = kept(places.join(held, ["file_id", "size", "modified_at_ms"], "left"), "listing")
    sure = F.coalesce(F.col("held") & exact_time(F.col("modified_at_ms")), F.lit(False))
    ready = {"extension": extension(F.col("filename")), "read_status": F.lit("ready"), "last_error": F.lit(None).cast("string"), "text": F.lit(None).cast("string")}
    return both.where(~sure).select(*places.columns), both.where(sure).withColumns(ready)


def finished(rows: DataFrame) -> DataFrame:
    """Rows of files with their bytes (content) as rows of a listing: hashes, format, status and text, without the bytes."""
    rows = inspected(rows.withColumn("content_hash", F.sha2("content", 256)))
    fingerprint = F.sha2(F.to_json(F.struct("size", "modified_at_ms", "content_hash")), 256)
    text = F.when(F.col("read_status") == "ready", F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", ""))
    return rows.withColumns({"fingerprint_hash": fingerprint, "text": text}).drop("content")


def versions(rows: DataFrame, root: str) -> DataFrame:
    """Listing rows (as of `listed`) with op and generation, of versions of files that come with their contents.

    rows: relative_path, content (binary; null for a deletion), modified_at_ms, op (`delete` or another) and generation.
    """
    top = root.rstrip("/")
    bare = "/" + top.split("://")[-1].removeprefix("file:").lstrip("/")
    identity, path = root_identity(F.lit(bare)), F.col("relative_path")
    said = rows.select(
        file_id(identity, path).alias("file_id"), identity.alias("root_identity"), "relative_path", F.concat(F.lit(f"{top}/"), path).alias("canonical_path"), basename(path).alias("filename"),
        F.coalesce(F.octet_length("content"), F.lit(0)).cast("long").alias("size"), F.col("modified_at_ms").cast("double").alias("modified_at_ms"), F.coalesce("content", F.lit("").cast("binary")).alias("content"), "op", F.col("generation").cast("long").alias("generation"),
    )
    return finished(said)


def coverage(spark: SparkSession, path: str, include: str = "") -> DataFrame:
    """Lines and functions found and hit of an LCOV report, over files whose path holds `include`; 100 % where none are found."""
    records = spark.read.option("lineSep", "end_of_record").text(path).where(F.contains("value", F.lit("SF:")))
    number = lambda tag: F.coalesce(F.try_to_number(F.regexp_extract("value", rf"(?m)^{tag}:(\d+)", 1), F.lit("9999999999")), F.lit(0)).cast("long")
    named = records.where(F.contains(F.regexp_extract("value", r"(?m)^SF:(.*)$", 1), F.lit(include)))
    summed = named.agg(F.count("*").alias("files"), *[F.coalesce(F.sum(number(t)), F.lit(0)).alias(n) for t, n in (("LF", "lines_found"), ("LH", "lines_hit"), ("FNF", "functions_found"), ("FNH", "functions_hit"))])
    percent = lambda kind: F.when(F.col(f"{kind}_found") == 0, 100.0).otherwise(100.0 * F.col(f"{kind}_hit") / F.col(f"{kind}_found"))
    return summed.withColumns({"lines_percent": percent("lines"), "functions_percent": percent("functions")})
