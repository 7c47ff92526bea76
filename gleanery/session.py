"""What every session needs for right results."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession


def safe_unions(spark: SparkSession) -> SparkSession:
    """spark, with unions that claim no partitioning.

    Spark 4.1 takes a union of equally partitioned parts for partitioned like them, also where adaptive execution has coalesced
    the parts apart: a later aggregation or window then runs without a shuffle and sees the rows of a key in several tasks.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


def with_safe_unions(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(safe_unions(spark), sf_dir)

    return run
