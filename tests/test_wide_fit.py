"""The fit with the basis as a table equals the fit with the basis on the driver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import facetry as fy
from facetry.operators.blocks import TooLarge
from facetry.plans import wide_fit as WF

from .conftest import features


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    truth = rng.normal(size=(11, 3))
    x = rng.dirichlet(np.full(3, 0.5), 200) @ truth.T + 0.1 * rng.normal(size=(200, 11))
    groups = np.where(np.arange(200) < 80, 0, np.arange(200) % 4)
    return features(spark, x, groups).repartition(3).persist()


def matrix_of(model):
    return np.array([r.w for r in sorted(model.basis_rows().collect(), key=lambda r: r.feature_id)])


@pytest.mark.parametrize(
    "options",
    [
        dict(solver="agd", noise_aware=True),
        dict(solver="admm"),
        dict(solver="admm", inner_tol=0.05),
        dict(solver="cease", hyper=1.0),
        dict(solver="admm", weights="nonnegative"),
    ],
)
def test_blocks_equal_the_driver(table, options):
    data = table.withColumn("features", F.transform("features", F.abs)) if options.get("weights") == "nonnegative" else table
    whole = fy.factorize(data, 3, lam=0.1, max_iter=3, seed=2, **options)
    model = WF.factorize_blocks(WF.feature_blocks(data, 4), 3, lam=0.1, max_iter=3, seed=2, part_cells=100, **options)
    for a, b in zip(whole.history, model.history, strict=True):
        np.testing.assert_allclose(a[2:8], b[2:8], rtol=1e-6, atol=1e-8)
    np.testing.assert_allclose(matrix_of(model), whole.basis, atol=1e-7)
    np.testing.assert_allclose(model.variances, whole.variances, rtol=1e-6)
    blocks = WF.feature_blocks(data, 4)
    one = {r.row_id: r.h for r in whole.weights(data).collect()}
    two = model.weights(blocks).collect()
    assert len(two) == 200
    for r in two:
        np.testing.assert_allclose(r.h, one[r.row_id], atol=1e-5)
    assert sorted(model.labels(blocks).collect()) == sorted(whole.labels(data).collect())


def test_blocks_of_rows_and_basis(spark, table):
    blocks = WF.feature_blocks(table, 4)
    assert {(r["first"], len(r.features)) for r in blocks.collect()} == {(0, 4), (4, 4), (8, 3)}
    drawn = fy.initial_basis(table, 3, "random_rows", seed=2)
    got = {r["first"]: np.reshape(r.cells, (-1, 3)) for r in WF.drawn_basis(blocks, 3, 2).collect()}
    np.testing.assert_allclose(np.concatenate([got[k] for k in sorted(got)]), drawn)
    again = {r["first"]: np.reshape(r.cells, (-1, 3)) for r in WF.basis_blocks(spark, drawn, 4).collect()}
    assert set(again) == {0, 4, 8}
    with pytest.raises(ValueError, match="fewer than"):
        WF.drawn_basis(blocks.where("row_id < 2"), 3)


def test_limits_name_their_remedy(table, monkeypatch):
    monkeypatch.setattr(WF, "GROUP_CELLS", 10)
    with pytest.raises(TooLarge, match="groups' matrices"):
        WF.factorize_blocks(WF.feature_blocks(table, 4), 3, max_iter=1)
