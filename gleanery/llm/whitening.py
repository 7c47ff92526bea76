"""Whitening of embeddings by incremental eigendecomposition.

Each task adds its vectors to a spectrum one by one: a centred rank-one update, whose new eigenvalues are the roots of a secular
equation. Spectra are united the same way, eigenpair by eigenpair, in a tree of small groups. What comes out is nearly
orthonormal and nearly invariant; a last pass over all rows projects the covariance on it (Rayleigh-Ritz), and the small
problem that remains gives the components to double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, remove, written
from .vectors import matrix

_EPS = np.finfo(np.float64).eps
SCALE, OFFSET = 1024, 100_000
#: Scaled entries beyond this are taken as this: their neighbours are no longer integers that a double tells apart.
WIDEST = 1 << 52
_LOW = (1 << 32) - 1


def secular_roots(poles: np.ndarray, weights: np.ndarray, rho: float) -> np.ndarray:
    """poles[j] - root[i] as a matrix [i, j], for the roots of 1/rho + sum(weights / (poles - root)) = 0.

    Poles ascend and differ, weights are positive and sum to 1, rho is positive: one root lies behind each pole. Each root is
    sought from the pole that is nearer, by interpolation with the two poles beside it (the last one: with its own pole) within
    a bracket that is halved where a step would leave it. Differences are exact to about a unit in the last place.
    """
    m = len(poles)
    half = (np.append(poles[1:], poles[-1] + rho) - poles) / 2
    each = np.arange(m)
    next_ = np.minimum(each + 1, m - 1)
    at_half = 1 / rho + (1 / (poles - (poles + half)[:, None])) @ weights
    right = (at_half < 0) & (each < m - 1)  # the nearer pole is the one above
    shifted = poles - poles[np.where(right, next_, each)][:, None]
    low, high = np.where(right, -half, 0.0), np.where(right, 0.0, half)
    if at_half[-1] < 0:  # the last root: in the upper half of its interval
        low[-1], high[-1] = half[-1], 2 * half[-1]
    step = (low + high) / 2
    below = (each <= each[:, None]).astype(np.float64)  # poles up to the root's own
    open_, own = each, shifted
    for _ in range(100):
        at, lane = step[open_], np.arange(len(open_))
        moved = own - at[:, None]
        terms = weights / moved
        value = 1 / rho + terms.sum(axis=1)
        slopes = terms / moved
        left, whole = np.einsum("ij,ij->i", slopes, below), slopes.sum(axis=1)
        under = value < 0
        low[open_[under]], high[open_[~under]] = at[under], at[~under]
        done = np.abs(value) <= 4 * _EPS * (1 / rho + np.abs(terms).sum(axis=1))
        first, second = moved[lane, open_], moved[lane, next_[open_]]
        with np.errstate(all="ignore"):
            c = value - first * left - second * (whole - left)
            a = (first + second) * value - first * second * whole
            b = first * second * value
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            to = at + np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            if open_[-1] == m - 1:
                to[-1] = at[-1] + first[-1] + first[-1] ** 2 * whole[-1] / (value[-1] - first[-1] * whole[-1])
        least, most = low[open_], high[open_]
        lost = ~((to > least) & (to < most))
        to = np.where(lost, (least + most) / 2, to)
        done |= (to == at) | lost & ((to == least) | (to == most))
        step[open_] = np.where(done, at, to)
        if done.all():
            break
        if done.any():
            open_, own, below = open_[~done], own[~done], below[~done]
    return shifted - step[:, None]


def rank_one(values: np.ndarray, vectors: np.ndarray, rho: float, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The eigenvalues (ascending) and eigenvectors (columns) of Q diag(values) Q' + rho v v', for rho >= 0.

    Directions that v does not touch, and all but one of those that share an eigenvalue, keep their pairs (deflation). The rest
    solve the secular equation; its vectors come from the weights of which the found roots are the exact ones, which makes them
    orthogonal whatever the roots' last digits.
    """
    z = vectors.T @ v
    norm = float(np.sqrt(z @ z))
    if rho <= 0 or norm == 0:
        return values, vectors
    z, rho = z / norm, rho * norm * norm
    tolerance = 8 * _EPS * max(float(np.abs(values).max()), rho)
    touched = rho * np.abs(z) > tolerance
    if not touched.all() or (np.diff(values) <= tolerance).any():
        values, vectors, z = values.copy(), vectors.copy(), z.copy()
        z[~touched] = 0
        at = np.flatnonzero(touched)
        for i, j in zip(at, at[1:]):  # a rotation takes the first of two alike directions out of v
            length = float(np.hypot(z[i], z[j]))
            s, c = z[i] / length, z[j] / length
            if (values[j] - values[i]) * abs(s * c) <= tolerance:
                vectors[:, i], vectors[:, j] = c * vectors[:, i] - s * vectors[:, j], s * vectors[:, i] + c * vectors[:, j]
                values[i], values[j] = c * c * values[i] + s * s * values[j], s * s * values[i] + c * c * values[j]
                z[i], z[j] = 0, length
        touched = z != 0
        order = np.argsort(values, kind="stable")
        values, vectors, z, touched = values[order], vectors[:, order], z[order], touched[order]
    poles, some = values[touched], z[touched]
    if not len(poles):
        return values, vectors
    gaps = secular_roots(poles, some * some / float(some @ some), rho * float(some @ some))
    roots = poles - gaps.diagonal()
    up_to = np.tri(len(poles) - 1, len(poles), dtype=bool)  # [i, j]: whether pole j is at or before pole i
    beside = np.where(up_to, poles - poles[1:, None], poles - poles[:-1, None])
    exact = np.sqrt(np.abs(gaps[-1] * np.prod(gaps[:-1] / beside, axis=0)))
    turn = (np.copysign(exact, some) / gaps).T
    turn /= np.sqrt((turn * turn).sum(axis=0))
    if touched.all():
        return roots, vectors @ turn
    values, vectors = values.copy(), vectors.copy()
    values[touched], vectors[:, touched] = roots, vectors[:, touched] @ turn
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Spectrum:
    """Number, mean and scatter of the vectors seen, the scatter as eigenpairs."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, dim: int) -> Spectrum:
        return cls(0, np.zeros(dim), np.zeros(dim), np.eye(dim))

    def shift(self, count: int, mean: np.ndarray) -> None:
        """Take in `count` equal vectors."""
        apart, whole = mean - self.mean, self.n + count
        self.values, self.vectors = rank_one(self.values, self.vectors, self.n * (count / whole), apart)
        self.mean, self.n = self.mean + apart * (count / whole), whole

    def add(self, rows: np.ndarray) -> None:
        distinct, counts = np.unique(rows, axis=0, return_counts=True)
        for row, count in zip(distinct, counts.tolist()):
            self.shift(count, row)

    def unite(self, other: Spectrum) -> None:
        """Take in another spectrum: one update for each of its eigenpairs, and one for the means."""
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, float(value), vector)
        self.shift(other.n, other.mean)


@dataclass
class Whitener:
    """What turns integer vectors into components: floor and rest of the mean, eigenvalues and vectors of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float = 0.0
    error: float = 0.0

    def __post_init__(self) -> None:
        self.floor = np.array([s // self.n for s in self.sums], np.int64)
        self.rest = np.array([s % self.n / self.n for s in self.sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n; the large part is subtracted in integers."""
        return (x - self.floor) - self.rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n x - sums)^2 of each row, exactly; None where that is no long."""
        apart = x - self.floor
        over = [s % self.n for s in self.sums]
        if self.n * (int(np.abs(apart).max(initial=0)) + 1) < 1 << 31 and len(over) < 1 << 10:
            exact = self.n * apart - np.array(over, np.int64)
            large = np.abs(exact).max(axis=1, initial=0)
            if int(large.max(initial=0)) ** 2 * len(over) < 1 << 63:
                return (exact * exact).sum(axis=1).tolist()
        found = [sum((self.n * a - o) ** 2 for a, o in zip(row, over)) for row in apart.tolist()]
        return [value if value < 1 << 63 else None for value in found]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)


def integers(rows: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * rows), -WIDEST, WIDEST).astype(np.int64)


def by_length(batches: Iterator[pd.DataFrame], column: str = "vector") -> Iterator[tuple[int, pd.DataFrame, np.ndarray]]:
    """Parts of batches whose vectors have one length, with their scaled integers (without the offset)."""
    for batch in batches:
        for dim, part in batch.groupby(batch[column].map(len), sort=True):
            yield int(dim), part, integers(matrix(part[column]))


def united(rows: DataFrame, unite: Callable[[list[pd.Series]], dict], fan: int = 8) -> DataFrame:
    """One row of each `dim` from rows (dim, part, ...): at most `fan` of them meet at a time, level by level."""
    held = written(rows, "parts")
    most = held.agg(F.max("part")).first()[0] or 0

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        first = group.iloc[0]
        return pd.DataFrame([{"dim": first["dim"], "part": first["part"], **unite([row for _, row in group.sort_values("part").iterrows()])}])

    found = held
    while True:
        found = found.withColumn("part", F.floor(F.col("part") / fan).cast("long")).groupBy("dim", "part").applyInPandas(meet, held.schema)
        most //= fan
        if not most:
            return found


def carried(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return low & _LOW, high + (low >> 32)


def fitted(rows: DataFrame, components: int) -> dict[int, Whitener]:
    """The whitener of each length of the vectors of rows; one spectrum a task, whose size follows from the length alone."""

    def spectra(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for dim, _, x in by_length(batches):
            own = held.setdefault(dim, [Spectrum.empty(dim), np.zeros(dim, np.int64), np.zeros(dim, np.int64)])
            own[0].add(x.astype(np.float64))
            own[1:] = carried(own[1] + (x & _LOW).sum(axis=0), own[2] + (x >> 32).sum(axis=0))
        part = TaskContext.get().partitionId()
        for dim, (s, low, high) in held.items():
            yield pd.DataFrame([{"dim": dim, "part": part, "n": s.n, "mean": s.mean, "low": low, "high": high, "eigenvalues": s.values, "eigenvectors": s.vectors.ravel()}])

    def unite(group: list[pd.Series]) -> dict:
        whole = Spectrum.empty(int(group[0]["dim"]))
        low = high = np.zeros(len(whole.mean), np.int64)
        for row in group:
            whole.unite(Spectrum(int(row["n"]), row["mean"], row["eigenvalues"], row["eigenvectors"].reshape(-1, len(row["mean"]))))
            low, high = carried(low + row["low"], high + row["high"])
        return {"n": whole.n, "mean": whole.mean, "low": low, "high": high, "eigenvalues": whole.values, "eigenvectors": whole.vectors.ravel()}

    schema = "dim int, part long, n long, mean array<double>, low array<long>, high array<long>, eigenvalues array<double>, eigenvectors array<double>"
    first: dict[int, Whitener] = {}
    for row in united(rows.mapInPandas(spectra, schema), unite).collect():  # one row a length
        basis = np.linalg.qr(np.array(row.eigenvectors).reshape(row.dim, row.dim))[0]
        first[row.dim] = Whitener(row.n, [low + (high << 32) for low, high in zip(row.low, row.high)], np.ones(row.dim), basis)
    if not first:
        return {}
    shared = rows.sparkSession.sparkContext.broadcast(first)  # bounded: a square matrix a length

    def projected(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for dim, _, x in by_length(batches):
            y = shared.value[dim].whitened(x)
            held[dim] = held.get(dim, 0) + y.T @ y
        for dim, gram in held.items():
            yield pd.DataFrame([{"dim": dim, "part": TaskContext.get().partitionId(), "gram": gram.ravel()}])

    grams = united(rows.mapInPandas(projected, "dim int, part long, gram array<double>"), lambda group: {"gram": np.sum([row["gram"] for row in group], axis=0)})
    found = {}
    for row in grams.collect():
        basis, dim = first[row.dim], row.dim
        values, turn = np.linalg.eigh(np.array(row.gram).reshape(dim, dim) / basis.n)
        top = [k for k in range(dim - 1, -1, -1) if values[k] > 1e-12 * values[-1]][:components]
        found[dim] = Whitener(basis.n, basis.sums, values[top], basis.vectors @ turn[:, top], float(values.sum()))
    return found


def whiten(table: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each row of table that has a vector and each of the `components` largest components of them all.

    Columns: vec_id, component (from 1), n, deviation, whitened, explained, identity_error. Entries become
    floor(1024 * entry) + 100000; entries beyond 2^42 or so count as that. Rows whose vector is null or has null or non-finite
    entries are left out; zero vectors and repeated rows count, null ids are carried along. Vectors of different lengths have no
    covariance: each length is fitted by itself (n, sums and components are its own), empty vectors give no rows. Components
    whose eigenvalue is zero (at most 1e-12 of the largest) cannot be whitened and are left out, so equal vectors alone, or one
    vector, give no rows. Where eigenvalues are equal, their components are some basis of their space, the same for all rows.
    A deviation beyond a long is null. Other columns are ignored; an empty table gives no rows.

    The table is read four times and not shuffled; only spectra and small square matrices are, one a task. A task's memory is a
    batch of rows and a spectrum of 8 bytes times the square of the length.
    """
    spark, c = table.sparkSession, F.col(vector_col)
    fine = c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size(c) > 0)
    rows = table.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), c.cast("array<double>").alias("vector"))
    found = fitted(rows.select("vector"), components)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    found = {dim: w for dim, w in found.items() if len(w.values)}
    if not found:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(found)  # bounded: the components of each length

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for dim, _, x in by_length(batches):
            if dim in shared.value:
                w = shared.value[dim].whitened(x)
                held[dim] = held.get(dim, 0) + w.T @ w
        for dim, gram in held.items():
            yield pd.DataFrame([{"dim": dim, "part": TaskContext.get().partitionId(), "gram": gram.ravel()}])

    again = united(rows.select("vector").mapInPandas(moments, "dim int, part long, gram array<double>"), lambda group: {"gram": np.sum([row["gram"] for row in group], axis=0)})
    for row in again.collect():
        own = found[row.dim]
        own.error = float(np.abs(np.array(row.gram).reshape(len(own.values), -1) / own.n - np.eye(len(own.values))).max())
    told = spark.sparkContext.broadcast(found)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for dim, part, x in by_length(batches):
            if dim not in told.value:
                continue
            own = told.value[dim]
            k = len(own.values)
            out = pd.DataFrame({"vec_id": np.repeat(part["vec_id"].astype("Int64").to_numpy(), k), "component": np.tile(np.arange(1, k + 1), len(part)), "n": own.n})
            out["vec_id"] = out["vec_id"].astype("Int64")
            out["deviation"] = pd.array(np.repeat(np.array(own.deviations(x), object), k), dtype="Int64")
            out["whitened"] = own.whitened(x).ravel()
            out["explained"] = np.tile(own.values / own.trace, len(part))
            out["identity_error"] = own.error
            yield out

    return rows.mapInPandas(project, schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"))
