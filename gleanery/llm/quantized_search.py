"""Approximate nearest neighbours by score-aware (anisotropic) quantisation.

Vectors are cut into subspaces, each coded in four bits. Codebooks and codes minimise a loss that weighs the part of the
residual parallel to the vector more than the rest, since that part is what moves large inner products. A query becomes a table
of its inner products with all centres; scanning the codes adds table entries up, and the best are ranked again exactly, as is
every row whose code does not rule out that it belongs among them.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table
from .vectors import matrix, search_shards, unit, usable

CENTRES = 16  # four bits


@dataclass(frozen=True)
class Settings:
    width: int = 2  # dimensions of a subspace
    threshold: float = 0.2  # cosines from here on are to be kept exact; sets the weight of the parallel residual
    sample: int = 8192  # vectors that codebooks are fitted on, at most
    rounds: int = 8
    sweeps: int = 2
    shard_floats: int = 1 << 21  # components of a shard's vectors
    rerank: int = 100  # of a shard, for each query, at first; then whatever could still be among the nearest
    seed: int = 5


class Codebook:
    """Centres of each subspace for unit vectors."""

    def __init__(self, sample: np.ndarray, settings: Settings):
        self.settings = s = settings
        n, self.dim = sample.shape
        self.parts = ceil(self.dim / s.width)
        self.parts += self.parts % 2  # two codes a byte
        self.parallel = max(1.0, (self.dim - 1) * s.threshold**2 / (1 - s.threshold**2))
        x = self._cut(unit(sample))
        draw = np.random.default_rng(s.seed)
        self.centres = np.stack([x[draw.choice(n, CENTRES, replace=n < CENTRES), p] for p in range(self.parts)])
        for _ in range(s.rounds):
            self._refit(x, self._assign(x, sweeps=1))

    def _cut(self, rows: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(rows), self.parts * self.settings.width))
        padded[:, : self.dim] = rows
        return padded.reshape(len(rows), self.parts, self.settings.width)

    def _assign(self, x: np.ndarray, sweeps: int) -> np.ndarray:
        """Codes: the nearest centres, then subspace by subspace whatever lowers the weighted loss given all others."""
        away = np.stack([((x[:, p, None, :] - self.centres[p][None]) ** 2).sum(-1) for p in range(self.parts)], axis=1)
        along = np.stack([(x[:, p] ** 2).sum(-1)[:, None] - x[:, p] @ self.centres[p].T for p in range(self.parts)], axis=1)
        codes = away.argmin(axis=2)
        row = np.arange(len(x))
        total = along[row[:, None], np.arange(self.parts)[None, :], codes].sum(axis=1)
        for _ in range(sweeps):
            for p in range(self.parts):
                rest = total - along[row, p, codes[:, p]]
                codes[:, p] = (away[:, p] + (self.parallel - 1) * (rest[:, None] + along[:, p]) ** 2).argmin(axis=1)
                total = rest + along[row, p, codes[:, p]]
        return codes

    def _refit(self, x: np.ndarray, codes: np.ndarray) -> None:
        """Each centre at the least weighted loss of the vectors that have it: a small linear system."""
        row = np.arange(len(x))
        left = np.stack([((x[:, p] - self.centres[p][codes[:, p]]) * x[:, p]).sum(-1) for p in range(self.parts)], axis=1)
        for p in range(self.parts):
            rest = left.sum(axis=1) - left[:, p]
            for c in range(CENTRES):
                own = row[codes[:, p] == c]
                if not len(own):
                    continue
                v = x[own, p]
                a = len(own) * np.eye(v.shape[1]) + (self.parallel - 1) * v.T @ v
                b = v.sum(axis=0) + (self.parallel - 1) * v.T @ (rest[own] + (v * v).sum(-1))
                self.centres[p, c] = np.linalg.solve(a, b)
            left[:, p] = ((x[:, p] - self.centres[p][codes[:, p]]) * x[:, p]).sum(-1)

    def encode(self, rows: np.ndarray) -> np.ndarray:
        """Codes of unit vectors, two to a byte."""
        codes = self._assign(self._cut(rows), self.settings.sweeps)
        return (codes[:, 0::2] * CENTRES + codes[:, 1::2]).astype(np.uint8)

    def decode(self, packed: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for."""
        codes = np.stack([packed // CENTRES, packed % CENTRES], axis=2).reshape(len(packed), self.parts)
        return self.centres[np.arange(self.parts), codes].reshape(len(packed), -1)[:, : self.dim]

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Queries x byte positions x 256: what each pair of codes adds to the inner product."""
        single = np.einsum("qpw,pcw->qpc", self._cut(queries), self.centres)
        return (single[:, 0::2, :, None] + single[:, 1::2, None, :]).reshape(len(queries), self.parts // 2, CENTRES * CENTRES).astype(np.float32)


class QuantizedShard:
    """The codes of a shard's rows, in order of id, and their vectors for the exact ranking."""

    def __init__(self, book: Codebook, ids: np.ndarray, vectors: np.ndarray):
        self.book, self.ids, self.vectors = book, ids, unit(vectors)
        packed = book.encode(self.vectors)
        self.codes = np.ascontiguousarray(packed.T)
        coded = book.decode(packed)
        self.along = np.einsum("nd,nd->n", self.vectors, coded)  # of the coded vector: its part along the row's own, and the rest
        self.aside = np.sqrt(np.maximum(0, (coded * coded).sum(axis=1) - self.along**2))

    def _least(self, cosine: float) -> np.ndarray:
        """The score that each row has at least if its cosine with a query is at least `cosine`.

        With a query at cosine c, the coded vector's part along the row adds c * along to the score and its rest takes off
        aside * sqrt(1 - c^2) at most. That grows with c from 0 on; below, and for codes that point away, nothing is ruled out.
        """
        if not cosine > 0:
            return np.full(len(self.ids), -np.inf)
        least = cosine * self.along - self.aside * np.sqrt(max(0.0, 1 - cosine**2)) - 1e-6 * (len(self.codes) + 1)  # single precision
        return np.where(self.along > 0, least, -np.inf)

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
        found = []
        queries = unit(queries)
        for at in range(0, len(queries), 64):
            tables = self.book.tables(queries[at : at + 64])
            scores = np.zeros((len(tables), len(self.ids)), np.float32)
            for p, codes in enumerate(self.codes):
                scores += tables[:, p][:, codes]
            for own, query, score in zip(query_ids[at : at + 64], queries[at : at + 64], scores):
                score[self.ids == own] = -np.inf
                want = min(max(k, self.book.settings.rerank), len(score))
                some = np.argpartition(score, len(score) - want)[len(score) - want :]
                exact = self.vectors[some[self.ids[some] != own]] @ query
                kth = np.partition(exact, len(exact) - k)[len(exact) - k] if len(exact) >= k else -np.inf
                some = np.flatnonzero((score >= self._least(kth)) & (self.ids != own))
                exact = self.vectors[some] @ query
                best = np.lexsort((self.ids[some], -exact))[:k]
                found += [(int(own), int(self.ids[some[b]]), float(exact[b])) for b in best]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])


def nearest_vectors(vectors: DataFrame, is_query: F.Column, k: int = 5, settings: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest by cosine of each query among all other vectors: query_id, rank, vec_id, score.

    Queries are the rows of `vectors` where is_query holds. Every row is indexed; codebooks are fitted on at most
    `settings.sample` rows of each length, the first by a hash of their id. Vectors of different lengths have no cosine: each
    length is searched by itself. Vectors that are null, zero or of null or non-finite components take no part, nor do rows of
    null id; rows that repeat an id count once, with the best score among them. Equal scores go by vec_id. Other columns are
    ignored; an empty table gives an empty result. Scores are exact, and so is the choice: codes only rule out rows that cannot
    be among the nearest. The number of shards follows from the number of rows alone.
    """
    spark = vectors.sparkSession
    rows = vectors.where(usable(vector_col) & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    schema = "query_id long, vec_id long, score double"
    found = spark.createDataFrame([], schema)
    for dim, count in sorted(tuple(r) for r in rows.groupBy(F.size("vector")).agg(F.count("*")).collect()):
        same = rows.where(F.size("vector") == dim)
        drawn = same.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(settings.sample).collect()
        book = spark.sparkContext.broadcast(Codebook(matrix([r.vector for r in drawn]), settings))  # bounded: 16 centres a subspace

        def open_shard(ids, held, book=book):
            shard = QuantizedShard(book.value, ids, held)
            return lambda query_ids, queries: shard.nearest(query_ids, queries, k)

        shards = ceil(count * dim / settings.shard_floats)
        found = found.unionByName(search_shards(same.select("id", "vector"), same.where("asked").select("id", "vector"), shards, open_shard, schema))
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(read_table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(50)) == 0)
