"""Row weights: optimality, limits, and independence of layout."""

import numpy as np
import pytest

import facetry as fy
from facetry.operators import weights as W

from .conftest import features


@pytest.mark.parametrize("rank", [1, 2, 4, 10])
@pytest.mark.parametrize("alpha", [1.0, 0.1, 1e-4])
def test_simplex_optimality(rank, alpha):
    rng = np.random.default_rng(rank)
    w, x = rng.normal(size=(30, rank)), rng.normal(size=(200, 30))
    h = W.simplex_minimiser(x @ w, w.T @ w, np.full(rank, alpha), eps=0.0)
    assert (h > 0).all()
    np.testing.assert_allclose(h.sum(axis=1), 1.0, atol=1e-9)
    if rank > 1:
        residual = h * (h @ (w.T @ w) - x @ w)
        price = (residual - alpha).sum(axis=1, keepdims=True)
        np.testing.assert_allclose(residual - alpha, h * price, atol=1e-7)


def test_simplex_survives_equal_columns_and_large_scale():
    w = np.repeat(np.arange(1.0, 9.0)[:, None], 4, axis=1)
    x = np.random.default_rng(0).normal(size=(50, 8)) * 1e4
    h = W.simplex_minimiser(x @ w, w.T @ w, np.full(4, 0.1))
    np.testing.assert_allclose(h, 0.25, atol=1e-6)


def test_simplex_is_clamped_without_renormalising():
    w = np.eye(3) * 1e3
    h = W.simplex_minimiser(np.array([[1e6, 0.0, 0.0]]), w.T @ w, np.full(3, 1e-4))
    assert h.min() == 1e-5
    assert 1.0 <= h.sum() <= 1.0 + 3e-5


def test_simplex_chunks_agree(monkeypatch):
    rng = np.random.default_rng(3)
    w, x = rng.normal(size=(12, 5)), rng.normal(size=(101, 12))
    whole = W.simplex_minimiser(x @ w, w.T @ w, np.full(5, 0.1))
    monkeypatch.setattr(W, "SYSTEM_CELLS", 200)
    np.testing.assert_allclose(W.simplex_minimiser(x @ w, w.T @ w, np.full(5, 0.1)), whole, atol=1e-12)


@pytest.mark.parametrize("rank", [1, 2, 5, 12])
def test_nonnegative_optimality(rank):
    rng = np.random.default_rng(rank)
    a, y = rng.normal(size=(30, rank)), rng.normal(size=(300, 30))
    q, b = a.T @ a, y @ a
    h = W.nonnegative_minimiser(b, q)
    slope = h @ q - b
    assert (h >= 0).all()
    assert slope.min() > -1e-8
    assert np.abs(h * slope).max() < 1e-8


def test_nonnegative_rank_deficient():
    a = np.ones((10, 3))
    h = W.nonnegative_minimiser(np.array([[20.0, 20.0, 20.0], [-1.0, -1.0, -1.0]]), a.T @ a)
    np.testing.assert_allclose(h.sum(axis=1), [2.0, 0.0], atol=1e-6)


@pytest.mark.parametrize("mode", ["simplex", "nonnegative"])
def test_layout_does_not_matter(spark, mode):
    rng = np.random.default_rng(1)
    df = features(spark, rng.normal(size=(60, 6)), rng.integers(0, 3, 60))
    basis = rng.normal(size=(6, 3))

    def solved(table):
        return fy.to_numpy(fy.row_weights(table, basis, mode), "h")

    np.testing.assert_allclose(solved(df.repartition(1)), solved(df.repartition(7)), atol=1e-12)


def test_group_bases(spark):
    rng = np.random.default_rng(2)
    x, g = rng.normal(size=(20, 4)), np.arange(20) % 2
    bases = {0: rng.normal(size=(4, 2)), 1: rng.normal(size=(4, 2))}
    got = fy.to_numpy(fy.row_weights(features(spark, x, g), bases), "h")
    for k, w in bases.items():
        want = W.simplex_minimiser(x[g == k] @ w, w.T @ w, np.full(2, 0.1))
        np.testing.assert_allclose(got[g == k], want, atol=1e-12)


def test_unknown_mode():
    with pytest.raises(ValueError):
        W.weight_kernel(np.eye(2), "other", 0.1, 1e-5)


@pytest.mark.parametrize("rank", [2, 3, 7, 16, 17])
def test_small_systems_are_eliminated_together(monkeypatch, rank):
    """Up to 16 unknowns no row has a LAPACK call of its own; the solutions are the same, and blocks of rows do not show in the weights."""
    rng = np.random.default_rng(rank)
    w = rng.normal(size=(rank + 4, rank))
    q, added, right = w.T @ w, rng.uniform(1e-3, 1e4, (rank, 50)), rng.normal(size=(rank, 50))
    want = [np.linalg.solve(q + np.diag(added[:, i]), np.stack([right[:, i], np.ones(rank)], axis=1)) for i in range(50)]
    x = rng.dirichlet(np.full(rank, 0.2), 300) @ w.T + 0.05 * rng.normal(size=(300, rank + 4))
    alpha = np.full(rank, 0.1)
    alone = np.concatenate([W.simplex_minimiser(row[None, :], q, alpha) for row in x @ w])
    if rank <= 16:
        monkeypatch.setattr(np.linalg, "solve", None)
    first, ones = W._solve_systems(q, added, right)
    assert np.allclose(first.T, [y[:, 0] for y in want], rtol=1e-9, atol=1e-12) and np.allclose(ones.T, [y[:, 1] for y in want], rtol=1e-9, atol=1e-12)
    monkeypatch.setattr(W, "CHUNK_ROWS", 37)
    h = W.simplex_minimiser(x @ w, q, alpha)
    assert np.abs(h - alone).max() < 1e-9 and np.abs(h.sum(axis=1) - 1).max() < 1e-3
