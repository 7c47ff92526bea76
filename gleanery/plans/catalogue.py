"""All queries on the given tables, with the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import with_safe_unions
from . import retrieval, tables

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "hybrid_search"


def queries() -> dict[str, Query]:
    return {name: with_safe_unions(query) for name, query in (retrieval.QUERIES | tables.QUERIES).items()}


def oracle_sql() -> dict[str, str]:
    return retrieval.SQL | tables.SQL
