"""Pools into one ranking of chunks, and chunks into files with excerpts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SearchConfig

SOURCES = ("vector", "bm25", "metadata")


def competition_rank(by: list[str], score: Column) -> Column:
    """1, 1, 3: equal scores share the rank of the first."""
    return F.rank().over(Window.partitionBy(*by).orderBy(score.desc()))


def reciprocal(rank: Column, k: float, weight: float) -> Column:
    return F.lit(float(weight)) / (F.lit(float(k)) + rank)


def fuse(pools: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """query_id, chunk_id, score, sources from query_id, source, chunk_id, raw_score: weighted reciprocal rank fusion.

    A chunk's best score in a pool counts. Contributions are added in the order of SOURCES, so equal sums are equal to the bit.
    """
    # one shuffle by query serves all that follows
    best = pools.repartition("query_id").groupBy("query_id", "source", "chunk_id").agg(F.max("raw_score").alias("raw_score"))
    ranked = best.withColumn("rank", competition_rank(["query_id", "source"], F.col("raw_score")))
    weights = {"vector": config.vector_weight, "bm25": config.bm25_weight, "metadata": config.metadata_weight}
    share = {s: F.coalesce(F.max(F.when(F.col("source") == s, reciprocal(F.col("rank"), config.rrf_k, weights[s]))), F.lit(0.0)) for s in SOURCES}
    score = share["vector"] + share["bm25"] + share["metadata"]
    return ranked.groupBy("query_id", "chunk_id").agg(score.alias("score"), F.array_sort(F.collect_set("source")).alias("sources"))


def positions(candidates: DataFrame) -> DataFrame:
    """candidates with in_file, their place among their query's and file's."""
    order = Window.partitionBy("query_id", "file_id").orderBy(F.desc("score"), "relative_path", "chunk_id")
    return candidates.withColumn("in_file", F.row_number().over(order))


def diverse_excerpts(candidates: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """Of each file the chunks to show, numbered: the best of each context first, then others, as many as settings say."""
    placed = positions(candidates)
    again = F.row_number().over(Window.partitionBy("query_id", "file_id", "context").orderBy("in_file")) > 1
    shown = Window.partitionBy("query_id", "file_id").orderBy("again", "in_file")
    return placed.withColumn("again", again).withColumn("excerpt", F.row_number().over(shown)).where(F.col("excerpt") <= config.excerpts_per_file)


def aggregate_files(candidates: DataFrame, files: int | None = None, config: SearchConfig = SearchConfig()) -> DataFrame:
    """The best files of each query: query_id, file_id, relative_path, score, n_chunks, sources, rank.

    A file scores its best chunk plus the others, each worth less by its place, up to a fixed part of the best.
    """
    placed = positions(candidates)
    more = F.when(F.col("in_file") > 1, F.col("score") * F.pow(F.lit(config.supplemental_decay), F.col("in_file") - 1)).otherwise(0.0)
    summed = placed.groupBy("query_id", "file_id", "relative_path").agg(
        F.max("score").alias("best"), F.sum(more).alias("more"), F.count("*").alias("n_chunks"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources")
    )
    scored = summed.withColumn("score", F.round(F.col("best") + F.least(F.col("more"), config.supplemental_cap * F.col("best")), 9)).drop("best", "more")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "relative_path", "file_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= (files or config.default_files))


def context(headings: Column, symbols: Column) -> Column:
    """What tells excerpts apart: the headings above, else the symbols, else nothing."""
    by = lambda values: F.when(F.size(values) > 0, F.lower(F.array_join(values, "\x1f", "")))
    return F.coalesce(by(headings), by(symbols), F.lit("unscoped"))
