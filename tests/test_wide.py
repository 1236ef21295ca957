"""Routes for wide tables: QR in panels, ridge and spectrum by passes, and K-Means on blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import facetry as fy
from facetry.operators import kmeans as KM
from facetry.operators import krylov as K
from facetry.operators import least_squares as L
from facetry.operators import wide_qr as WQ
from facetry.operators.blocks import TooLarge
from facetry.plans import compare as C

from .conftest import features


def to_matrix(df, key="row_id"):
    return np.array([r.features for r in sorted(df.select(key, "features").collect())])


@pytest.mark.parametrize("panel", [5, 9, 40])
def test_panels_give_the_whole_qr(spark, panel):
    """Also for a table whose columns differ by ten orders of magnitude and nearly depend on each other."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 23)) * 10.0 ** np.linspace(-5, 5, 23)
    x[:, 7] = x[:, 6] * 3 + 1e-7 * x[:, 7]
    df = features(spark, x).withColumn("part", F.lit("clash")).repartition(4)
    found = WQ.wide_qr(df, 23, panel=panel)
    r, q = to_matrix(found.r_rows(), "i"), to_matrix(found.q)
    assert found.q.columns == df.columns
    np.testing.assert_allclose(q.T @ q, np.eye(23), atol=1e-11)
    # Panels are multiplied by the inverse of their R, whose condition here is 1e10: that many digits less than rounding.
    np.testing.assert_allclose((q @ r) / np.linalg.norm(x, axis=0), x / np.linalg.norm(x, axis=0), atol=1e-9)
    assert (np.diagonal(r) > 0).all() and np.abs(np.tril(r, -1)).max() == 0
    want = np.linalg.qr(x, mode="r")
    want *= np.sign(np.diagonal(want))[:, None]
    # From the nearly dependent column on, R itself is not determined to more digits than that leaves.
    np.testing.assert_allclose((r / np.linalg.norm(x, axis=0))[:, :7], (want / np.linalg.norm(x, axis=0))[:, :7], atol=1e-9)


@pytest.mark.parametrize("panel", [2, 7, 30])
def test_solve_in_panels(spark, panel):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(120, 12)), rng.normal(size=(120, 3))
    rows = [(i, a.tolist(), *map(float, b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "row_id int, features array<double>, y0 double, y1 double, y2 double")
    got = WQ.least_squares_wide(df, ["y0", "y1", "y2"], 12, panel=panel)
    np.testing.assert_allclose(got, np.linalg.lstsq(x, y, rcond=None)[0], atol=1e-10)


def test_ridge_by_passes(spark):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(200, 40)), rng.normal(size=(200, 2))
    y[:, 1] = 0.0  # a target that is zero has no chain
    rows = [(i, a.tolist(), *map(float, b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "row_id int, features array<double>, y0 double, y1 double").repartition(3)
    want = L.ridge(df, ["y0", "y1"], [0.0, 1.0, 50.0])
    got = K.ridge_wide(df, ["y0", "y1"], [0.0, 1.0, 50.0], tol=1e-12)
    for lam in want:
        np.testing.assert_allclose(got[lam], want[lam], atol=1e-9)
    with pytest.raises(K.NotSolved):
        K.ridge_wide(df, ["y0"], [0.0], tol=1e-12, max_steps=3)


def test_ridge_of_a_rank_deficient_table(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 3)) @ rng.normal(size=(3, 10))
    y = rng.normal(size=60)
    df = spark.createDataFrame([(i, a.tolist(), float(b)) for i, (a, b) in enumerate(zip(x, y))], "row_id int, features array<double>, y double")
    got = K.ridge_wide(df, ["y"], [0.0])[0.0][:, 0]
    np.testing.assert_allclose(got, np.linalg.lstsq(x, y, rcond=None)[0], atol=1e-8)


def test_spectrum_equals_the_gram_matrix(spark):
    x = np.random.default_rng(8).normal(size=(400, 30)) * np.linspace(0.01, 3, 30)
    values = np.linalg.eigvalsh(x.T @ x)
    low, high, quotient = K.extreme_eigenvalues(features(spark, x).repartition(3))
    assert low == pytest.approx(values[0], rel=1e-6) and high == pytest.approx(values[-1], rel=1e-6)
    assert quotient == pytest.approx(values[-1] / values[0], rel=1e-5)


def test_vectors_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(K, "MAX_CELLS", 100)
    with pytest.raises(TooLarge, match="Lanczos"):
        K.extreme_eigenvalues(features(spark, np.random.default_rng(9).normal(size=(80, 30))))


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(10)
    centres = rng.normal(size=(5, 6)) * 8
    labels = rng.integers(0, 5, 600)
    labels[:250] = 2  # one class has most rows
    return features(spark, centres[labels] + rng.normal(size=(600, 6)), labels=labels), labels


def test_kmeans_finds_planted_classes(clustered):
    df, labels = clustered
    for seed in range(4):
        got = {r.row_id: r.pred_label for r in C.kmeans_labels(df, 5, seed).collect()}
        assert len({(labels[i], got[i]) for i in range(600)}) == 5


def test_kmeans_does_not_depend_on_layout(clustered):
    df, _ = clustered
    one = sorted(C.kmeans_labels(df.coalesce(1), 5, 3, keep=("label",)).collect())
    two = sorted(C.kmeans_labels(df.repartition(11), 5, 3, keep=("label",)).collect())
    assert one == two and one[0].__fields__ == ["row_id", "label", "pred_label"]
    a = fy.initial_basis(df.coalesce(1), 3, "kmeans", seed=2)
    np.testing.assert_allclose(a, fy.initial_basis(df.repartition(9), 3, "kmeans", seed=2), atol=1e-12)


def test_kmeans_steps_equal_plain_steps(clustered):
    df, _ = clustered
    x = to_matrix(df)
    centres = x[:4].copy()
    got, steps = KM.kmeans_steps(fy.pack_blocks(df.repartition(5)), centres, max_iter=3, tol=0.0)
    for _ in range(3):
        at = np.argmin(((x[:, None, :] - centres[None]) ** 2).sum(axis=2), axis=1)
        centres = np.stack([x[at == k].mean(axis=0) for k in range(4)])
    assert steps == 3
    np.testing.assert_allclose(got, centres, atol=1e-10)


def test_kmeans_of_few_distinct_rows(spark):
    df = features(spark, np.repeat([[0.0, 0.0], [5.0, 5.0]], 30, axis=0))
    assert len(KM.kmeans(df, 4)) == 2
    with pytest.raises(ValueError, match="distinct centres"):
        fy.initial_basis(df, 4, "kmeans", seed=1)
    with pytest.raises(ValueError, match="empty"):
        KM.kmeans(df.where("false"), 2)
    far = KM.kmeans_steps(fy.pack_blocks(df), np.array([[0.0, 0.0], [5.0, 5.0], [99.0, 99.0]]))[0]
    np.testing.assert_allclose(far, [[0, 0], [5, 5], [99, 99]])
