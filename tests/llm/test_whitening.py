"""Whitening against a dense decomposition in numpy."""

import math
from fractions import Fraction

import numpy as np
import pytest

from gleanery.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, n long, component string, vector string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 9, "c", "v") for i, v in rows], SCHEMA)


def test_rank_one_updates():
    draw = np.random.default_rng(0)
    for trial in range(200):
        d = int(draw.integers(1, 12))
        values = np.sort(draw.choice([0, 0, 1, 1, 2, 3.5, 1e-9, 1e6, 1 + 1e-14], d)) if trial % 2 else np.sort(draw.exponential(size=d))
        basis = np.linalg.qr(draw.normal(size=(d, d)))[0]
        v = draw.normal(size=d) * 10.0 ** draw.integers(-8, 4)
        v = basis[:, 0] * 2 if trial % 5 == 0 else v * (trial % 7 > 0)
        rho = 10.0 ** draw.integers(-3, 3)
        found, vectors = whitening.rank_one(values, basis, rho, v)
        expect = basis @ np.diag(values) @ basis.T + rho * np.outer(v, v)
        assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-12
        assert np.abs(vectors @ np.diag(found) @ vectors.T - expect).max() <= 1e-12 * np.abs(expect).max()
        assert (np.diff(found) >= 0).all()


def test_roots_lie_between_poles():
    draw = np.random.default_rng(1)
    for m in (1, 2, 5, 40):
        poles, weights = np.sort(draw.normal(size=m)), draw.dirichlet(np.full(m, 0.05)) + 1e-9
        weights /= weights.sum()
        gaps = whitening.secular_roots(poles, weights, 0.7)
        roots = poles - gaps.diagonal()
        assert (roots >= poles).all() and (roots[:-1] <= poles[1:]).all()
        assert np.allclose(roots, np.linalg.eigvalsh(np.diag(poles) + 0.7 * np.outer(np.sqrt(weights), np.sqrt(weights))), atol=1e-13)


def test_spectra_unite_as_if_seen_at_once():
    draw = np.random.default_rng(2)
    rows = np.floor(1000 * draw.normal(size=(300, 9))) * np.linspace(0.1, 1, 9)
    rows[50:150] = rows[50]  # a third are copies
    parts = [whitening.Spectrum.empty(9) for _ in range(3)]
    for part, some in zip(parts, np.split(rows, [40, 41])):
        part.add(some)
    parts[0].unite(parts[1])
    parts[0].unite(parts[2])
    expect = np.linalg.eigvalsh(np.cov(rows.T, bias=True) * 300)
    assert parts[0].n == 300 and np.allclose(parts[0].mean, rows.mean(axis=0), rtol=1e-12)
    assert np.abs(parts[0].values - expect).max() < 1e-12 * expect[-1]


def expected(vectors):
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    centred = np.array([[float(Fraction(int(a)) - Fraction(int(s), n)) for a, s in zip(row, sums)] for row in x])
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    return n, [int(sum((n * a - s) ** 2 for a, s in zip(row, sums))) for row in x], centred, values[::-1], basis[:, ::-1]


def test_whitening_as_a_dense_decomposition(spark):
    draw = np.random.default_rng(3)
    vectors = draw.normal(size=(500, 12)) * np.linspace(0.02, 1, 12) @ draw.normal(size=(12, 12))
    vectors[100:270] = vectors[100]
    vectors[3] = 0
    odd = [(900, None), (901, [1.0, None] + [0.0] * 10), (902, [float("nan")] * 12), (903, [float("inf")] + [0.0] * 11), (904, [])]
    rows = [(None if k == 7 else 8 if k == 9 else k, v) for k, v in enumerate(vectors)]
    found = whitening.whiten(table(spark, rows + odd).repartition(5)).collect()
    n, deviations, centred, values, basis = expected(vectors)
    ids = [i for i, _ in rows]
    assert len(found) == 8 * n and {r.n for r in found} == {n} and {r.component for r in found} == set(range(1, 9))
    assert sorted(str(r.vec_id) for r in found) == sorted(str(i) for i in ids for _ in range(8))
    assert all(r.identity_error < 1e-9 for r in found)
    at = {i: k for k, i in enumerate(ids) if i is not None and i != 8}
    for c in range(1, 9):
        own = [r for r in found if r.component == c and r.vec_id in at]
        whole = centred @ basis[:, c - 1] / math.sqrt(values[c - 1])
        got, expect = np.array([r.whitened for r in own]), np.array([whole[at[r.vec_id]] for r in own])
        sign = np.sign(got @ expect)
        assert np.abs(sign * got - expect).max() < 1e-9
        assert all(r.deviation == deviations[at[r.vec_id]] and abs(r.explained / (values[c - 1] / values.sum()) - 1) < 1e-12 for r in own)


def test_each_length_by_itself_and_flat_directions(spark):
    draw = np.random.default_rng(4)
    long, short = draw.normal(size=(40, 6)), draw.normal(size=(30, 3))
    short[:, 2] = short[:, 0]  # a direction without spread
    found = whitening.whiten(table(spark, [(k, v) for k, v in enumerate([*long, *short])])).collect()
    assert {(r.n, r.component) for r in found} == {(40, c) for c in range(1, 7)} | {(30, 1), (30, 2)}
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0])] * 3)).collect() == []
    assert whitening.whiten(table(spark, [])).collect() == [] and whitening.whiten(table(spark, [(1, None)])).collect() == []


def test_deviations_are_exact_or_null():
    w = whitening.Whitener(3, [1 << 40, 5], np.ones(2), np.eye(2))
    x = np.array([[1 << 20, 1], [0, 0], [1 << 50, 2]])
    expect = [sum((3 * int(a) - s) ** 2 for a, s in zip(row, [1 << 40, 5])) for row in x]
    assert w.deviations(x) == [e if e < 1 << 63 else None for e in expect]


@pytest.mark.parametrize("parts", [1, 70])
def test_any_number_of_tasks(spark, parts):
    draw = np.random.default_rng(5)
    vectors = draw.normal(size=(200, 4)) + 50
    found = whitening.whiten(table(spark, list(enumerate(vectors))).repartition(parts), components=2).collect()
    *_, values, _ = expected(vectors)
    assert len(found) == 400 and max(abs(r.explained - values[r.component - 1] / values.sum()) for r in found) < 1e-12
