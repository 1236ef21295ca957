"""The alternating fit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import facetry as fy
from facetry.plans import factorize as fit

from .conftest import features


@pytest.fixture(scope="module")
def planted(spark):
    keys = fy.assign_groups(spark.range(600).withColumnRenamed("id", "row_id"), 4, F.col("row_id") % 4)
    made = fy.planted(keys, fy.banded_basis(5, 3, 1, 1.5), alpha=0.1, sigmas=[0.1, 0.1, 0.1, 0.5], seed=2).persist()
    yield made
    made.unpersist()


def test_objective_never_rises(planted):
    model = fy.factorize(planted, 3, solver="agd", lam=0.5, noise_aware=False, max_iter=12, seed=1, inner_iter=300)
    values = np.array([h[3] for h in model.history])
    assert (np.diff(values) <= 1e-6 * np.abs(values[:-1])).all()


@pytest.mark.parametrize("solver,hyper", [("agd", 0.0), ("admm", 50.0), ("cease", 1e-4)])
def test_planted_classes_are_found(planted, solver, hyper):
    models = fy.repeat_fit(planted, 3, [1, 2, 3], solver=solver, hyper=hyper, lam=0.5, max_iter=8)
    best = fit.best_of(models)
    from facetry.plans.compare import evaluate

    accuracy, f1, _ = evaluate(planted, best.labels(planted))
    assert accuracy > 0.9 and f1 > 0.9
    noisy = best.variances[3]
    assert noisy > 3 * best.variances[:3].max()


def test_layout_does_not_matter(planted):
    options = dict(solver="admm", lam=0.5, max_iter=3, seed=4)
    one = fy.factorize(planted.repartition(1), 3, **options)
    seven = fy.factorize(planted.repartition(7), 3, **options)
    np.testing.assert_allclose(one.basis, seven.basis, atol=1e-8)


def test_one_group_may_hold_most_rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 5))
    groups = np.where(np.arange(300) < 250, 0, np.arange(300) % 4)
    model = fy.factorize(features(spark, x, groups).repartition(6), 2, solver="agd", max_iter=2, seed=1)
    assert model.groups.tolist() == [0, 1, 2, 3]
    assert model.weights(features(spark, x, groups)).count() == 300


def test_driver_and_spark_updates_agree(planted):
    for solver in ("agd", "admm", "cease"):
        options = dict(solver=solver, hyper=5.0, lam=0.5, max_iter=2, seed=4, noise_aware=True)
        local = fy.factorize(planted, 3, **options)
        wide = fy.factorize(planted, 3, driver_cells=10, **options)
        np.testing.assert_allclose(wide.basis, local.basis, atol=1e-8)


def test_pooled_groups_agree(planted):
    for aware in (False, True):
        options = dict(solver="agd", lam=0.5, max_iter=3, seed=4, noise_aware=aware)
        local = fy.factorize(planted, 3, **options)
        pooled = fy.factorize(planted, 3, pool_groups=True, **options)
        np.testing.assert_allclose(pooled.basis, local.basis, atol=1e-8)
        np.testing.assert_allclose(pooled.variances, local.variances, rtol=1e-8)
        np.testing.assert_allclose(pooled.history[-1][2], local.history[-1][2], rtol=1e-8)
    with pytest.raises(ValueError):
        fy.factorize(planted, 3, solver="admm", pool_groups=True, max_iter=1)


def test_early_pooling_agrees_with_group_statistics(planted):
    from facetry.operators import basis as B
    from facetry.operators import group_stats as G

    basis = fy.normal_basis(13, 3, seed=1)
    groups = np.arange(4)
    own = G.read_state(G.solved_statistics(planted, basis), groups, 13, 3)
    pooled = G.read_pooled(G.solved_statistics(planted, basis, pool=True), groups, 13, 3)
    np.testing.assert_allclose(pooled.gram[0], own.gram.sum(axis=0))
    np.testing.assert_allclose(pooled.cross[:, 0], own.cross.sum(axis=1), atol=1e-9)
    np.testing.assert_allclose(pooled.sum_h, own.sum_h)
    np.testing.assert_allclose(pooled.sse, own.sse)
    equal = np.full(4, 0.25)
    want, _ = B.BasisStep("agd", 0.5, equal).solve(own.cross, own.gram, basis)
    model = fy.factorize(planted, 3, solver="agd", lam=0.5, noise_aware=False, init=basis, max_iter=1)
    np.testing.assert_allclose(model.basis, want, atol=1e-10)


def test_group_basis(planted):
    model = fy.factorize(planted, 3, solver="admm", hyper=50.0, h_basis="group", lam=0.5, max_iter=3, seed=1)
    assert sorted(model.copies) == [0, 1, 2, 3]
    assert model.labels(planted).count() == 600
    assert model.labels(planted.withColumn("group_id", F.lit(99))).count() == 600


@pytest.mark.parametrize("normalize", ["group", "global"])
def test_nonnegative_fit(spark, normalize):
    rng = np.random.default_rng(1)
    w, h = rng.random((8, 2)), rng.random((200, 2))
    df = features(spark, h @ w.T, np.arange(200) % 3)
    model = fy.factorize(
        df, 2, solver="agd", lam=1e-6, weights="nonnegative", normalize=normalize, max_iter=10, seed=2, inner_iter=200
    )
    assert fy.to_numpy(model.weights(df), "h").min() >= 0
    errors = [row[5] for row in model.history]
    assert errors[-1] < errors[0]


def test_tolerance_stops_early(planted):
    model = fy.factorize(planted, 3, solver="agd", lam=0.5, max_iter=50, tol=1e-2, seed=1)
    assert len(model.history) < 50


def test_starts(planted):
    a = fy.initial_basis(planted, 3, "random_rows", seed=1)
    rows = fy.to_numpy(planted)
    assert all((np.abs(rows - a[:, k]).max(axis=1) < 1e-12).any() for k in range(3))
    assert fy.initial_basis(planted, 3, "kmeans", seed=1).shape == a.shape
    np.testing.assert_array_equal(
        fy.initial_basis(planted, 3, "normal", seed=1), fy.initial_basis(planted, 3, "normal", seed=1)
    )
    with pytest.raises(ValueError):
        fy.initial_basis(planted, 3, "other")


@pytest.mark.parametrize("init", ["random_rows", "normal"])
def test_cached_blocks_and_plain_rows_agree(planted, init):
    options = dict(solver="agd", lam=0.5, max_iter=2, seed=4, init=init)
    packed = fy.factorize(planted, 3, cache=True, **options)
    plain = fy.factorize(planted, 3, cache=False, **options)
    np.testing.assert_allclose(packed.basis, plain.basis, atol=1e-8)


def test_blocks_and_rows_draw_the_same_sample(planted):
    """The built-in K-Means depends on the layout of its input, so its start is compared by its sample."""
    from facetry.operators.blocks import unpack_drawn
    from facetry.plans.factorize import _drawn

    drawn = unpack_drawn(fy.pack_blocks(planted), 4, 0.1).select("row_id", "features").orderBy("row_id").collect()
    want = _drawn(planted, 4).filter("draw < 0.1").select("row_id", "features").orderBy("row_id").collect()
    assert drawn == want and len(want) > 30
    model = fy.factorize(planted, 3, solver="agd", lam=0.5, max_iter=2, seed=4, init="kmeans")
    assert np.isfinite(model.basis).all()


@pytest.mark.parametrize("cache", [True, False])
def test_ragged_input_fails(spark, cache):
    rows = [(k, 0, [1.0, 2.0, 3.0][: 3 if k == 5 else 2 - (k == 6)]) for k in range(10)]
    df = spark.createDataFrame(rows, "row_id bigint, group_id int, features array<double>").coalesce(1)
    with pytest.raises(Exception, match="row_id 5"):
        fy.factorize(df, 1, max_iter=1, cache=cache, init="normal")


def test_bad_arguments(planted):
    with pytest.raises(ValueError):
        fy.factorize(planted, 3, h_basis="other")
    with pytest.raises(ValueError):
        fy.factorize(planted, 3, weights="nonnegative", h_basis="group")
    with pytest.raises(ValueError):
        fy.factorize(planted, 3, init=np.zeros((2, 2)))


def test_ragged_rows_name_the_row(spark):
    df = spark.createDataFrame(
        [(1, 0, [1.0, 2.0]), (77, 0, [1.0])], "row_id bigint, group_id int, features array<double>"
    ).coalesce(1)
    with pytest.raises(Exception, match="row_id 77"):
        fy.check_width(df, 2).collect()


def test_known_weights_reach_the_truth(spark):
    keys = fy.assign_groups(spark.range(400).withColumnRenamed("id", "row_id"), 2, F.col("row_id") % 2)
    truth = fy.banded_basis(5, 3, 1, 1.5)
    df = fy.planted(keys, truth, alpha=1.0, seed=3)
    w, variances, history = fy.fit_basis(
        df, np.zeros_like(truth), solver="cease", hyper=1.0, noise_aware=True, rounds=2, inner_iter=60, truth=truth
    )
    np.testing.assert_allclose(w, truth, atol=1e-6)
    assert history[-1][4] < history[0][4]


def test_variance_ratio_follows_theory(spark):
    keys = fy.assign_groups(spark.range(500).withColumnRenamed("id", "row_id"), 5, F.col("row_id") % 5)
    from facetry.plans.compare import variance_ratio

    found = fy.variance_experiment(keys, fy.banded_basis(6, 3, 1, 1.5), [1.0, 1.0, 1.0, 1.0, 6.0], 30)
    empirical = variance_ratio(found.estimates).first()[0]
    theory = found.theory_aware.mean() / found.theory_plain.mean()
    assert abs(empirical - theory) < 0.5 * theory
