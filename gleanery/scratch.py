"""Intermediate tables in the folder that all machines see."""

from __future__ import annotations

import re
import tempfile
import uuid
from math import ceil

from pyspark.sql import DataFrame, SparkSession

from .session import safe_unions


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only where that is unset and Spark is local, as in tests, one is made."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines see")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="gleanery-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written once and read again: it is computed once however often it is used, and a lost executor costs nothing of it.

    Spark also knows its size from then on, and chooses joins by it.
    """
    spark = safe_unions(df.sparkSession)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, key: str, rows: DataFrame, most: int) -> DataFrame:
    """df dealt out by a hash of key, in a part for each `most` of `rows`: a task's work stays the same as the input grows.

    Files that compress well hold many rows in one split; what is made of each row, and sorted, would then be one task's.
    """
    return df.repartition(max(1, ceil(rows.count() / most)), key)
