"""What the operators of this package share: reading tables, durable intermediate tables, text batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import safe_unions


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines see (spark.checkpoint.dir). Only where that is unset and Spark is local, as in tests, one is made."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines see")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="gleanery-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here, so a lost executor costs no recomputation of it."""
    spark = df.sparkSession
    safe_unions(spark)
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete the files of a table made by written() that is no longer needed."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def few_broadcast(table: DataFrame, limit: int = 100_000) -> DataFrame:
    """table, marked for broadcast if it has at most `limit` rows. For narrow tables: ids, names, counts."""
    return F.broadcast(table) if table.limit(limit + 1).count() <= limit else table


def sampled_by_group(rows: DataFrame, group: str, limit: Column, spare: int = 4) -> DataFrame:
    """Of each group the first `limit` rows (of its value) by a hash of id; group and id are columns. rows is read twice.

    Counts by group say which hashes come too late to be among the first, so a group's last choice sees about `spare` times its
    limit, whatever its size. One row a group is broadcast where they are few; else Spark joins them by its own measure.
    """
    spread = F.xxhash64("id", F.lit(11)).cast("double") / 2.0**64 + 0.5
    counts = rows.groupBy(F.col(group).alias("__group")).agg(F.count("*").alias("__n"))
    early = rows.join(few_broadcast(counts), F.col(group).eqNullSafe(F.col("__group"))).where(spread * F.col("__n") <= spare * limit + 64)
    first = Window.partitionBy(group).orderBy(F.xxhash64("id", F.lit(11)), "id")
    return early.withColumn("__at", F.row_number().over(first)).where(F.col("__at") <= limit).drop("__at", "__n", "__group")


def slices(texts: Iterable[str | None], limit: int = 1 << 20) -> Iterator[list[str]]:
    """Consecutive texts (null as empty) in lists of about `limit` characters; a longer text is a list of its own."""
    part: list[str] = []
    held = 0
    for text in texts:
        text = text if isinstance(text, str) else ""
        if part and held + len(text) > limit:
            yield part
            part, held = [], 0
        part.append(text)
        held += len(text)
    if part:
        yield part
