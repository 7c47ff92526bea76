"""What the operators on vectors share: which vectors count, and vectors and queries dealt to shards as sorted streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def usable(vector: str) -> F.Column:
    """Neither null nor zero, and no component null or non-finite."""
    c = F.col(vector)
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return c.isNotNull() & fine & F.exists(c, lambda x: x != 0)


def matrix(column) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in column])


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def partition_keys(spark: SparkSession, count: int) -> list[int]:
    """For each of `count` hash partitions an int that falls into it: shards named so are dealt one to a partition."""
    key = F.col("id").cast("int")
    first = spark.range(40 * count).groupBy(F.pmod(F.hash(key), F.lit(count)).alias("part")).agg(F.min(key).alias("key"))
    found = {r.part: r.key for r in first.collect()}
    return [found.get(part, -1 - part) for part in range(count)]


def dealt_evenly(df: DataFrame, number: str, parts: int) -> DataFrame:
    """df in `parts` partitions, rows by their number (from 0) modulo parts: as even as numbers are, which hashes of few are not."""
    keys = F.array(*[F.lit(k) for k in partition_keys(df.sparkSession, parts)])
    return df.withColumn("__part", F.get(keys, F.pmod(F.col(number), F.lit(parts)).cast("int"))).repartition(parts, "__part").drop("__part")


def search_shards(data: DataFrame, queries: DataFrame, shards: int, open_shard: Callable, schema: str) -> DataFrame:
    """Every query against every shard of the data: data rows once, queries once a shard.

    Both have id (long) and vector. A shard's rows arrive first and are held (shards are sized to fit); its queries follow in
    batches of any number. `open_shard(ids, vectors)` returns a function of a query batch (ids, vectors) that returns a pandas
    frame of `schema`.
    """
    keys = F.array(*[F.lit(k) for k in partition_keys(data.sparkSession, shards)])
    shard = F.get(keys, F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    rows = data.select(shard.alias("shard"), F.lit(0).alias("kind"), "id", "vector")
    asked = queries.select(F.explode(keys).alias("shard"), F.lit(1).alias("kind"), "id", "vector")
    dealt = rows.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "kind", "id")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, ids, held, ask = None, [], [], None
        for batch in batches:
            for own, part in batch.groupby("shard", sort=True):
                if own != at:
                    at, ids, held, ask = own, [], [], None
                rows, asked = part[part["kind"] == 0], part[part["kind"] == 1]
                if len(rows):
                    ids.append(rows["id"].to_numpy())
                    held.append(matrix(rows["vector"]))
                if len(asked) and held:
                    if ask is None:
                        ask = open_shard(np.concatenate(ids), np.concatenate(held))
                        held = [True]
                    for k in range(0, len(asked), 1024):
                        some = asked.iloc[k : k + 1024]
                        yield ask(some["id"].to_numpy(), matrix(some["vector"]))

    return dealt.mapInPandas(search, schema)
