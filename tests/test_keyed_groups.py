"""Groups as keyed rows give what the driver gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import facetry as fy
from facetry.operators import basis as B
from facetry.operators import group_stats as G
from facetry.operators import keyed_groups as K
from facetry.operators.blocks import TooLarge
from facetry.operators.weights import row_weights

from .conftest import features


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    truth = rng.normal(size=(9, 3))
    x = rng.dirichlet(np.full(3, 0.5), 300) @ truth.T + 0.1 * rng.normal(size=(300, 9))
    groups = np.where(np.arange(300) < 110, 0, np.arange(300) % 13)  # one group has over a third of the rows
    return features(spark, x, groups).repartition(5).persist()


def keyed_of(table, basis, cells):
    return K.keyed_groups(G.solved_partials(table, basis), 9, 3, cells)


def start():
    return np.random.default_rng(1).normal(size=(9, 3))


@pytest.mark.parametrize("cells", [1_000_000, 12, 3])
def test_rows_hold_the_statistics(table, cells):
    """One row for every group and block of features, whatever the block; with the sums the driver would have."""
    w = start()
    state = G.read_state(G.solved_statistics(table, w), G.group_ids(table), 9, 3)
    rows = sorted(keyed_of(table, w, cells).collect(), key=lambda r: (r.group_id, r.first))
    per_block = min(9, cells // 3)
    assert [(r.group_id, r["first"]) for r in rows] == [(g, f) for g in range(13) for f in range(0, 9, per_block)]
    for r in rows:
        low = r["first"]
        high = min(9, low + per_block)
        np.testing.assert_allclose(r.cross, state.cross[low:high, r.group_id].ravel(), atol=1e-12)
        np.testing.assert_allclose(r.gram, state.gram[r.group_id].ravel(), atol=1e-12)
        np.testing.assert_allclose(r.scalars[:2], [state.n[r.group_id], state.sse[r.group_id]], atol=1e-9)
    found, total, _ = K.keyed_state(keyed_of(table, w, cells), 3)
    np.testing.assert_allclose(found.sse, state.sse)
    np.testing.assert_allclose(found.logs, state.logs)
    np.testing.assert_allclose(total, state.sum_h.sum(axis=0))


@pytest.mark.parametrize("solver,hyper,lam", [("admm", 5.0, 0.5), ("admm", 5.0, 0.0), ("cease", 1.0, 0.5), ("cease", 1.0, 0.0), ("agd", 0.0, 0.5)])
@pytest.mark.parametrize("aware", [True, False])
def test_updates_equal_the_driver(table, solver, hyper, lam, aware):
    w = start()
    state = G.read_state(G.solved_statistics(table, w), G.group_ids(table), 9, 3)
    variances = G.noise_variances(state, 9)
    omega = B.precision_weights(variances) if aware else np.full(13, 1 / 13)
    step = B.BasisStep(solver, lam, omega, hyper, inner_tol=1e-3)
    want, copies = step.solve(state.cross, state.gram, w)
    shares = K.Shares(13, 9, float((1 / variances).sum()) if aware else None)
    got = K.update_keyed_basis(keyed_of(table, w, 12).persist(), step, w, shares, want_copies=copies is not None)
    np.testing.assert_allclose(got.basis, want, atol=1e-10)
    assert got.violation == pytest.approx(B.violation(copies, want), abs=1e-10)
    if copies is not None:
        for r in got.copies.collect():
            low = r["first"]
            np.testing.assert_allclose(np.reshape(r.cells, (-1, 3)), copies[low : low + len(r.cells) // 3, r.group_id], atol=1e-10)


@pytest.mark.parametrize(
    "options",
    [
        dict(solver="admm"),
        dict(solver="cease", hyper=1.0),
        dict(solver="cease", hyper=1.0, h_basis="group"),
        dict(solver="admm", h_basis="group"),
        dict(solver="admm", weights="nonnegative"),
        dict(solver="cease", hyper=1.0, weights="nonnegative", normalize="global"),
        dict(solver="agd", weights="nonnegative"),
    ],
)
def test_fits_equal_the_driver(table, options):
    """History, basis, variances and weights are the same with all matrices of the groups in Spark."""
    data = table.withColumn("features", F.transform("features", F.abs)) if options.get("weights") == "nonnegative" else table
    small = fy.factorize(data, 3, lam=0.1, max_iter=3, seed=1, **options)
    keyed = fy.factorize(data, 3, lam=0.1, max_iter=3, seed=1, key_groups=True, **options)
    for a, b in zip(small.history, keyed.history, strict=True):
        np.testing.assert_allclose(a[2:8], b[2:8], rtol=1e-6, atol=1e-9)
    np.testing.assert_allclose(small.basis, keyed.basis, atol=1e-7)
    np.testing.assert_allclose(small.variances, keyed.variances, rtol=1e-7)
    assert (keyed.copies_table is not None) == ("h_basis" in options) and keyed.copies is None
    one = {r.row_id: r for r in small.weights(data, keep=("label",)).collect()}
    two = keyed.weights(data, keep=("label",)).collect()
    assert len(one) == len(two) == 300 and two[0].__fields__ == ["row_id", "group_id", "label", "h"]
    for r in two:
        np.testing.assert_allclose(r.h, one[r.row_id].h, atol=1e-5)


def test_parts_split_a_hot_group(table):
    """No part of a group has more rows than asked for by far, and the group with a third of the table has many; unknown groups see the shared basis."""
    parts = K.part_rows(table, 9, part_cells=9 * 20)
    sizes = parts.groupBy("group_id", "part").count().collect()
    assert sum(r["count"] for r in sizes) == 300 and max(r["count"] for r in sizes) < 40
    assert len([r for r in sizes if r.group_id == 0]) > 4
    w, other = start(), -start()
    copies = table.sparkSession.createDataFrame([(0, 0, other[:4].ravel().tolist()), (0, 4, other[4:].ravel().tolist())], K.COPIES)
    got = {r.row_id: r.h for r in K.own_basis_weights(table, copies, w, "simplex", 0.1, 1e-5).collect()}
    for r in row_weights(table, {0: other, None: w}).collect():
        np.testing.assert_allclose(got[r.row_id], r.h, atol=1e-9)


def test_default_route_where_matrices_are_too_many(table, monkeypatch):
    from facetry.plans import factorize as fit

    small = fy.factorize(table, 3, lam=0.1, max_iter=2, seed=1)
    monkeypatch.setattr(fit, "BASIS_CELLS", 100)
    big = fy.factorize(table, 3, lam=0.1, max_iter=2, seed=1)
    np.testing.assert_allclose(small.basis, big.basis, atol=1e-8)
    own = fy.factorize(table, 3, lam=0.1, max_iter=2, seed=1, h_basis="group", driver_cells=10)
    assert own.copies_table is not None


def test_walk_is_bounded(table, monkeypatch):
    monkeypatch.setattr(K, "WALK_CELLS", 100)
    with pytest.raises(TooLarge, match="bases of one update"):
        K.update_keyed_basis(keyed_of(table, start(), 100), B.BasisStep("admm", 0.1, np.ones(1)), start(), K.Shares(13, 9))


@pytest.mark.parametrize(
    "options",
    [
        dict(solver="admm"),
        dict(solver="agd"),
        dict(solver="cease", hyper=1.0, h_basis="group"),
        dict(solver="cease", hyper=1.0, weights="nonnegative"),
        dict(solver="admm", tol=0.05),
        dict(solver="admm", cache=False),
    ],
)
def test_runs_together_equal_single_runs(table, options):
    """Each run is the fit of its seed; runs that stop early do not hold up the others."""
    data = table.withColumn("features", F.transform("features", F.abs)) if options.get("weights") == "nonnegative" else table
    together = fy.repeat_fit(data, 3, [4, 9, 2], lam=0.1, max_iter=4, **options)
    for k, (seed, model) in enumerate(zip([4, 9, 2], together, strict=True), start=1):
        alone = fy.factorize(data, 3, lam=0.1, max_iter=4, seed=seed, run=k, **options)
        assert len(alone.history) == len(model.history) and {r[0] for r in model.history} == {k}
        for a, b in zip(alone.history, model.history):
            np.testing.assert_allclose(a[1:8], b[1:8], rtol=1e-7, atol=1e-10)
        np.testing.assert_allclose(alone.basis, model.basis, atol=1e-8)
        np.testing.assert_allclose(alone.variances, model.variances)


def test_runs_share_their_passes(table, monkeypatch):
    """Five runs make as many passes as one; too many statistics send them one after the other, with the same result."""
    from facetry.plans import factorize as fit

    passes = []
    real = fit.stacked_statistics
    monkeypatch.setattr(fit, "stacked_statistics", lambda *a, **k: passes.append(1) or real(*a, **k))
    jobs = table.sparkSession.sparkContext.statusTracker()
    before = len(jobs.getJobIdsForGroup(None))
    models = fy.repeat_fit(table, 3, range(5), lam=0.1, max_iter=3)
    together = len(jobs.getJobIdsForGroup(None)) - before
    assert len(passes) == 3
    before = len(jobs.getJobIdsForGroup(None))
    apart = fy.repeat_fit(table, 3, range(5), lam=0.1, max_iter=3, driver_cells=400)
    assert len(passes) == 3 and len(jobs.getJobIdsForGroup(None)) - before > together
    for a, b in zip(models, apart, strict=True):
        np.testing.assert_allclose(a.basis, b.basis, atol=1e-7)
