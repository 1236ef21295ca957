"""Basis updates: one optimum for all solvers, and the same result on the driver and in Spark."""

from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest

from facetry.operators import basis as B
from facetry.operators import group_stats as G

from .conftest import features


def problem(m=30, r=4, c=5, n=200, seed=0):
    rng = np.random.default_rng(seed)
    truth = rng.normal(size=(m, r))
    hs = [rng.dirichlet(np.ones(r), n) for _ in range(c)]
    xs = [h @ truth.T + 0.5 * rng.normal(size=(n, m)) for h in hs]
    grams = np.stack([h.T @ h for h in hs])
    cross = np.stack([x.T @ h for x, h in zip(xs, hs)], axis=1)
    return truth, xs, hs, cross, grams


def value(w, cross, grams, omega, lam):
    g, p = np.tensordot(omega, grams, 1), np.einsum("c,fcr->fr", omega, cross)
    return 0.5 * np.einsum("fr,rs,fs->", w, g, w) - (w * p).sum() + lam / len(omega) * np.abs(w).sum()


OMEGAS = {"equal": np.full(5, 0.2), "uneven": np.array([0.1, 0.3, 0.2, 0.35, 0.05])}


@pytest.mark.parametrize("name", list(OMEGAS))
@pytest.mark.parametrize("lam", [0.0, 2.0])
def test_solvers_share_one_optimum(name, lam):
    omega = OMEGAS[name]
    _, _, _, cross, grams = problem()
    start = np.random.default_rng(9).normal(size=(30, 4))
    best = B.BasisStep("ista", lam, omega, max_iter=20000).solve(cross, grams, start)[0]
    floor = value(best, cross, grams, omega, lam)
    for solver, hyper, steps in (("agd", 0, 200), ("admm", 5.0, 500), ("cease", 1.0, 30)):
        step = B.BasisStep(solver, lam, omega, hyper, max_iter=steps, local_iter=200)
        w, copies = step.solve(cross, grams, start)
        assert value(w, cross, grams, omega, lam) - floor < 1e-8 * abs(floor), solver
        if copies is not None:
            assert B.violation(copies, w) < 1.0
    standard = B.BasisStep("agd", lam, omega, max_iter=2000, momentum="standard").solve(cross, grams, start)[0]
    np.testing.assert_allclose(standard, best, atol=1e-6)


def test_default_steps_lower_the_objective():
    omega = OMEGAS["equal"]
    _, _, _, cross, grams = problem()
    start = np.random.default_rng(9).normal(size=(30, 4))
    for solver, hyper in (("agd", 0), ("ista", 0), ("admm", 5.0), ("cease", 1e-4)):
        w = B.BasisStep(solver, 2.0, omega, hyper).solve(cross, grams, start)[0]
        assert value(w, cross, grams, omega, 2.0) < value(start, cross, grams, omega, 2.0)


def test_local_fista_lowers_the_objective():
    """Five features, rank two, a hundred Dirichlet rows, lambda .05: the objective falls."""
    rng = np.random.default_rng(4)
    truth, start = rng.random((5, 2)), rng.random((5, 2))
    h = rng.dirichlet([1, 1], 100)
    g, p = h.T @ h, truth @ h.T @ h

    def loss(w):
        return 0.5 * np.square(truth @ h.T - w @ h.T).sum() + 0.05 * np.abs(w).sum()

    w = B.fista(lambda v: v @ g - p, start, float(B.top_eigenvalue(g)), 0.05, 20)
    assert loss(w) < loss(start)


def test_soft_threshold():
    a = np.zeros((2, 2))
    a[0, 0] = -1.5
    np.testing.assert_allclose(B.soft(a, 0.1), [[-1.4, 0.0], [0.0, 0.0]])


def long_table(spark, xs, hs):
    rows, k = [], 0
    for c, (x, h) in enumerate(zip(xs, hs)):
        for xi, hi in zip(x, h):
            rows.append((k, c, [float(v) for v in xi], [float(v) for v in hi]))
            k += 1
    return spark.createDataFrame(rows, "row_id bigint, group_id int, features array<double>, h array<double>")


@pytest.mark.parametrize("solver,hyper", [("agd", 0.0), ("admm", 5.0), ("cease", 1.0)])
def test_blocks_of_features_give_the_same_basis(spark, solver, hyper):
    _, xs, hs, cross, grams = problem(n=20)
    stats = G.weighted_statistics(long_table(spark, xs, hs)).persist()
    state = G.read_state(stats, np.arange(5), 30, 4)
    np.testing.assert_allclose(state.cross, cross, atol=1e-10)
    np.testing.assert_allclose(state.gram, grams, atol=1e-10)
    start = np.random.default_rng(1).normal(size=(30, 4))
    step = B.BasisStep(solver, 1.0, OMEGAS["uneven"], hyper)
    want = step.solve(state.cross, state.gram, start)[0]
    got, gap = B.update_wide_basis(stats, state, step, start, block_cells=7 * 5 * 4)
    np.testing.assert_allclose(got, want, atol=1e-10)
    copies = step.solve(state.cross, state.gram, start)[1]
    assert gap == pytest.approx(B.violation(copies, want), abs=1e-9)
    if solver == "admm":
        early = replace(step, max_iter=60, inner_tol=1e-2)
        iterates = step.__class__.path(early, state.cross, state.gram, start)
        assert 5 <= len(iterates) < 60
        got, gap = B.update_wide_basis(stats, state, early, start, block_cells=7 * 5 * 4)
        np.testing.assert_allclose(got, iterates[-1][0], atol=1e-10)
        assert gap == pytest.approx(B.violation(iterates[-1][1], got), abs=1e-9)
    stats.unpersist()


@pytest.mark.parametrize("every", [1, 3, 100])
def test_partial_sums_survive_flushing(monkeypatch, every):
    """However often a task hands over its sums, they add up to the same statistics."""
    _, xs, hs, cross, grams = problem(n=20)
    monkeypatch.setattr(G, "SLAB_ROWS", 7)
    groups = np.repeat(np.arange(5), 20)
    order = np.random.default_rng(0).permutation(100)
    x, h, g = np.concatenate(xs)[order], np.concatenate(hs)[order], groups[order]
    sums, batches = G._Sums(), []
    for k, part in enumerate(np.array_split(np.arange(100), 9)):
        sums.add(g[part], x[part], h[part], np.ones(part.size))
        if k % every == 0:
            batches += list(sums.flush())
    batches += list(sums.flush())
    cells = pa.Table.from_batches(list(G._add_partials(iter(batches)))).to_pandas().groupby(["group_id", "kind", "i", "j"], as_index=False)["value"].sum()
    state = G.state_from_cells(*(cells[c].to_numpy() for c in ("group_id", "kind", "i", "j", "value")), np.arange(5), 30, 4)
    np.testing.assert_allclose(state.cross, cross, atol=1e-10)
    np.testing.assert_allclose(state.gram, grams, atol=1e-10)
    np.testing.assert_allclose(state.n, 20)
    np.testing.assert_allclose(state.sse, 20)
    assert len(batches) > (9 // every)


def test_sums_are_handed_over_when_full(monkeypatch):
    monkeypatch.setattr(G, "FLUSH_CELLS", 50)
    sums = G._Sums()
    for g in range(9):
        assert not sums.full()
        sums.add(np.array([g]), np.ones((1, 4)), np.ones((1, 2)), None)
    assert sums.full()


def test_packed_rows_give_the_same_statistics(spark):
    from facetry.operators.blocks import pack_blocks

    rng = np.random.default_rng(5)
    df = features(spark, rng.normal(size=(97, 6)), rng.integers(0, 3, 97)).repartition(3)
    basis = rng.normal(size=(6, 2))
    plain = G.read_state(G.solved_statistics(df, basis), np.arange(3), 6, 2)
    packed = G.read_state(G.solved_statistics(pack_blocks(df, block_bytes=6 * 8 * 10), basis), np.arange(3), 6, 2)
    np.testing.assert_allclose(packed.cross, plain.cross, atol=1e-10)
    np.testing.assert_allclose(packed.sse, plain.sse, atol=1e-10)
    np.testing.assert_array_equal(packed.n, plain.n)


def test_moment_errors_match_residuals():
    truth, xs, hs, cross, grams = problem()
    state = G.GroupState(
        np.arange(5), np.full(5, 200.0), np.zeros(5), np.zeros(5), np.array([np.square(x).sum() for x in xs]),
        np.stack([h.sum(axis=0) for h in hs]), grams, cross,
    )
    want = [np.square(x - h @ truth.T).sum() for x, h in zip(xs, hs)]
    np.testing.assert_allclose(B.squared_errors(state, truth), want, rtol=1e-9)


def test_rescaling_keeps_the_product_and_guards_zero():
    _, _, _, cross, grams = problem()
    sum_h = np.ones((5, 4)) * 50
    sum_h[2, 1] = 0.0
    state = G.GroupState(np.arange(5), np.full(5, 200.0), np.zeros(5), np.zeros(5), np.zeros(5), sum_h, grams, cross)
    for mode in ("group", "global"):
        scaled, s = G.rescale_groups(state, mode)
        assert np.isfinite(scaled.cross).all() and (s > 0).all()
        np.testing.assert_allclose(scaled.cross * s[None], cross)
        np.testing.assert_allclose(scaled.gram * s[:, :, None] * s[:, None, :], grams)
    with pytest.raises(ValueError):
        G.rescale_groups(state, "other")


def test_estimated_variance_is_smaller_when_aware():
    _, _, _, _, grams = problem()
    plain, aware = B.estimate_variance(grams, np.array([1.0, 1.0, 1.0, 1.0, 8.0]), 100.0)
    assert (aware < plain).all()
    same_plain, same_aware = B.estimate_variance(grams, np.ones(5), 100.0)
    np.testing.assert_allclose(same_plain, same_aware)


def test_statistics_too_large_for_the_driver_raise(spark):
    from facetry.operators.blocks import TooLarge

    _, xs, hs, _, _ = problem(n=5)
    with pytest.raises(TooLarge):
        G.read_state(G.weighted_statistics(long_table(spark, xs, hs)), np.arange(5), 30, 4, max_cells=100)
