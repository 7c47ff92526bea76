"""Vectors kept by cell: a coarse quantiser deals them out, and a query looks into the cells nearest to it alone."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SearchConfig
from . import retrieval

#: The cell of vectors that no quantiser has dealt out, and of those that it cannot (another length, zero, not finite).
NO_CELL = -1


def usable(vectors: list, dim: int) -> np.ndarray:
    """Which vectors have `dim` finite numbers, not all zero."""
    return np.array([v is not None and len(v) == dim and bool(np.isfinite(v).all()) and bool(np.any(v)) for v in vectors], bool)


def units(vectors: list) -> np.ndarray:
    rows = np.stack([np.asarray(v, np.float64) for v in vectors])
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


@dataclass(frozen=True)
class Quantiser:
    """Centres of cells as unit vectors, and how many vectors there were when it was made."""

    centres: np.ndarray
    trained_on: int

    @staticmethod
    def stored(table: DataFrame) -> Quantiser | None:
        """From the table `quantiser`: a row a cell, sqrt of the number of vectors at most."""
        rows = table.orderBy("cell").collect()
        return Quantiser(np.array([r.centre for r in rows]), rows[0].trained_on) if rows else None

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(k, [float(x) for x in centre], self.trained_on, None) for k, centre in enumerate(self.centres)]
        return spark.createDataFrame(rows, "cell int, centre array<double>, trained_on long, file_id string")

    def nearest(self, rows: np.ndarray, count: int = 1) -> np.ndarray:
        """The `count` nearest cells of unit vectors, nearest first."""
        scores = rows @ self.centres.T
        return np.argsort(-scores, axis=1, kind="stable")[:, :count]


def trained(vectors: DataFrame, rows: int, dim: int, sample: int = 65_536, rounds: int = 12, seed: int = 7) -> Quantiser | None:
    """A quantiser of about sqrt(rows) cells, at most an eighth of the sample: spherical k-means over at most `sample` vectors.

    The sample is drawn by a hash of chunk_id; only it comes to the driver. Every vector is dealt out by the centres later.
    """
    share = min(1.0, 2.0 * sample / max(1, rows))
    spread = F.xxhash64("chunk_id", F.lit(seed)).cast("double") / 2.0**64 + 0.5
    drawn = vectors.where((spread <= share) & (F.size("vector") == dim)).select("vector").limit(sample).collect()
    drawn = [r.vector for r in drawn]
    fine = [v for v, good in zip(drawn, usable(drawn, dim)) if good] if drawn else []
    if not fine:
        return None
    points, draw = units(fine), np.random.default_rng(seed)
    cells = max(1, min(ceil(sqrt(rows)), len(points) // 8))
    centres = points[draw.choice(len(points), cells, replace=False)]
    for _ in range(rounds):
        own = np.concatenate([np.argmax(part @ centres.T, axis=1) for part in np.array_split(points, max(1, len(points) // 8192))])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        counts = np.bincount(own, minlength=cells)
        for k in np.flatnonzero(counts == 0):  # an empty cell takes over a point of the fullest one
            sums[k] = points[draw.choice(np.flatnonzero(own == counts.argmax()))]
        lengths = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(lengths > 0, sums / np.where(lengths > 0, lengths, 1), centres)
    return Quantiser(centres, rows)


def dealt(vectors: DataFrame, quantiser: Quantiser | None) -> DataFrame:
    """Rows (chunk_id, file_id, format, vector) with their cell; no shuffle."""
    rows = vectors.select("chunk_id", "file_id", "format", "vector")
    if quantiser is None:
        return rows.select(F.lit(NO_CELL).alias("cell"), "*")
    shared = vectors.sparkSession.sparkContext.broadcast(quantiser)  # bounded: the sample's eighth of centres at most

    @F.pandas_udf("int")
    def cell(column: pd.Series) -> pd.Series:
        found = np.full(len(column), NO_CELL, np.int32)
        good = usable(column.to_list(), shared.value.centres.shape[1])
        if good.any():
            found[good] = shared.value.nearest(units(column[good].to_list()))[:, 0]
        return pd.Series(found)

    return rows.select(cell("vector").alias("cell"), "*")


def pool(cells: DataFrame, quantiser: Quantiser | None, queries: DataFrame, config: SearchConfig = SearchConfig(), probes: int | None = None) -> DataFrame:
    """Like retrieval.vector_pool, of chunks kept by cell: each query meets the chunks of its `probes` nearest cells.

    Without a quantiser, every chunk is met. `probes` follows from settings (see config.cell_probes) unless given. Chunks without
    a cell are always met, so what has been added since the quantiser was made is found as well. The cells of a block of queries
    are a filter of the scan: folders of others are not opened.
    """
    if quantiser is None:
        return retrieval.vector_pool(cells, queries, config)
    count = len(quantiser.centres)
    most = min(count, probes or max(1, ceil(config.cell_probes * count)))

    def block(some: DataFrame) -> DataFrame:
        asked = [r.asDict() for r in some.collect()]  # a block of at most max_batch queries
        good = usable([r["query_vector"] for r in asked], quantiser.centres.shape[1]) if asked else np.zeros(0, bool)
        asked = [r for r, fine in zip(asked, good) if fine]
        wanted = units([r["query_vector"] for r in asked]) if asked else np.zeros((0, quantiser.centres.shape[1]))
        near = quantiser.nearest(wanted, most) if asked else np.zeros((0, most), int)
        looks = np.zeros((len(asked), count + 1), bool)  # the last column: chunks without a cell
        looks[np.arange(len(asked))[:, None], near] = True
        looks[:, count] = True
        opened = sorted({NO_CELL, *np.flatnonzero(looks[:, :count].any(axis=0)).tolist()})
        return retrieval.scanned(cells.where(F.col("cell").isin(opened)), dict(queries.dtypes)["query_id"], asked, wanted, config, looks)

    return retrieval.blocked(block, queries, config.max_batch)


def recall(cells: DataFrame, quantiser: Quantiser | None, queries: DataFrame, config: SearchConfig = SearchConfig(), probes: int | None = None) -> float:
    """The part of the exact pool that the cells find, over the queries given."""
    exact = retrieval.vector_pool(cells, queries, config).select("query_id", "chunk_id")
    found = pool(cells, quantiser, queries, config, probes).select("query_id", "chunk_id")
    whole = exact.count()
    return exact.join(found, ["query_id", "chunk_id"], "left_semi").count() / whole if whole else 1.0


def probes_for(cells: DataFrame, quantiser: Quantiser, least: float, config: SearchConfig = SearchConfig(), queries: int = 64) -> int:
    """How many cells a query must look into for a recall of `least`: doubled until a sample of stored vectors reaches it.

    Each sampled vector asks for its own neighbours, in small turns and against all chunks; looking into every cell is exact.
    """
    drawn = cells.where(F.col("cell") != NO_CELL).orderBy(F.xxhash64("chunk_id", F.lit(5)), "chunk_id").limit(queries)
    asked = drawn.select(F.col("chunk_id").alias("query_id"), F.col("vector").cast("array<double>").alias("query_vector"))
    asked = cells.sparkSession.createDataFrame(asked.collect(), asked.schema)
    probes, count = max(1, ceil(config.cell_probes * len(quantiser.centres))), len(quantiser.centres)
    while probes < count and recall(cells, quantiser, asked, config, probes) < least:
        probes = min(count, 2 * probes)
    return probes
