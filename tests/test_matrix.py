"""Table-level matrix operators against numpy, with plans that scale."""

import contextlib
import io
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

import facetry as fy
from facetry.functions import arrays as A
from facetry.operators import extreme_columns as X
from facetry.operators import group_stats as G
from facetry.operators import least_squares as L
from facetry.operators import matrix as M
from facetry.operators import tsqr as Q
from facetry.plans import separable_nmf as S

from .conftest import features


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def block():
    return np.random.default_rng(0).normal(size=(57, 4))


@pytest.fixture(scope="module")
def table(spark, block):
    return features(spark, block, np.arange(57) % 3).repartition(5).persist()


def test_missing_partner_raises(spark, block, table):
    with pytest.raises(Exception, match="row_id 56"):
        M.combine(table, table.filter("row_id < 56"), "+").collect()


def test_combine_needs_no_common_layout(block, table):
    got = fy.to_numpy(M.combine(table.repartition(2), table.repartition(9), "+"))
    np.testing.assert_allclose(got, 2 * block)


def test_about_equal_sees_negative_differences(table):
    shifted = table.withColumn("features", A.scalar_op("features", "+", 5.0))
    row = M.about_equal(table, shifted).first()
    assert row.max_abs_diff == pytest.approx(5.0) and not row.equal
    assert M.about_equal(table, table).first().equal


def test_reductions_have_no_hidden_zero(spark):
    df = features(spark, np.array([[2.0, 3.0], [4.0, 5.0]]))
    row = M.reduce_cells(df, "min", "prod").first()
    assert row["min"] == 2.0 and row["prod"] == pytest.approx(120.0)
    assert [r["sum"] for r in M.row_sums(df).orderBy("row_id").collect()] == [5.0, 9.0]
    assert [r["sum"] for r in M.column_sums(df).orderBy("feature_id").collect()] == [6.0, 8.0]


def test_samples_depend_on_keys_only(table):
    a = {r.row_id for r in M.sample_rows(table.repartition(1), 0.3, 2).collect()}
    b = {r.row_id for r in M.sample_rows(table.repartition(8), 0.3, 2).collect()}
    assert a == b and 0 < len(a) < 57
    exact = [r.row_id for r in M.sample_exact(table, 10, 2).collect()]
    assert len(set(exact)) == 10
    assert exact == [r.row_id for r in M.sample_exact(table.repartition(3), 10, 2).collect()]


def test_group_gram(block, table):
    rows = G.group_gram(table).collect()
    got = np.zeros((3, 4, 4))
    for r in rows:
        got[r.group_id, r.i, r.j] = r.value
    for g in range(3):
        part = block[np.arange(57) % 3 == g]
        np.testing.assert_allclose(got[g], part.T @ part, atol=1e-10)


def test_gram_and_norms_in_one_pass(block, table):
    c, norms = G.gram_and_norms(table)
    np.testing.assert_allclose(c, block.T @ block, atol=1e-10)
    np.testing.assert_allclose(norms, np.abs(block).sum(axis=0), atol=1e-10)
    with pytest.raises(Exception, match="at most 3"):
        G.gram_matrix(table, max_cells=15)


def test_qr(block, table):
    r = Q.r_matrix(table)
    np.testing.assert_allclose(r.T @ r, block.T @ block, atol=1e-10)
    assert (np.diagonal(r) >= 0).all() and np.allclose(r, np.triu(r))
    np.testing.assert_allclose(r, Q.mllib_r(table), atol=1e-10)
    q = fy.to_numpy(Q.thin_q(table, r))
    np.testing.assert_allclose(q.T @ q, np.eye(4), atol=1e-10)
    np.testing.assert_allclose(q @ r, block, atol=1e-10)


def test_qr_with_fewer_rows_than_columns_and_more_levels(spark, block, table):
    short = features(spark, block[:3])
    r = fy.to_numpy(Q.tsqr_r(short).withColumnRenamed("i", "row_id"))
    np.testing.assert_allclose(r.T @ r, block[:3].T @ block[:3], atol=1e-10)
    spark.conf.set("spark.sql.shuffle.partitions", "70")
    try:
        deep = Q.r_matrix(table.repartition(40))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    np.testing.assert_allclose(deep, Q.r_matrix(table), atol=1e-10)


def test_least_squares(block, table):
    y = block @ np.array([1.0, -2.0, 0.5, 3.0]) + 0.1 * np.sin(np.arange(57))
    target = F.lit(0.0)
    for k, w in enumerate([1.0, -2.0, 0.5, 3.0]):
        target = target + w * F.get("features", F.lit(k))
    df = table.withColumn("y", target + 0.1 * F.sin("row_id"))
    want = np.linalg.lstsq(block, y, rcond=None)[0]
    np.testing.assert_allclose(Q.least_squares_qr(df, ["y"])[:, 0], want, atol=1e-9)
    solved = L.ridge(df, ["y"], [0.0, 2.0])
    np.testing.assert_allclose(solved[0.0][:, 0], want, atol=1e-9)
    np.testing.assert_allclose(
        solved[2.0][:, 0], np.linalg.solve(block.T @ block + 2 * np.eye(4), block.T @ y), atol=1e-9
    )


def brute_columns(x, rank):
    """The greedy choice in the space of rows, with weights by trying every set of free variables."""
    chosen, residual = [], x
    for _ in range(rank):
        scores = [np.linalg.norm(np.maximum(residual.T @ x[:, j], 0)) / np.linalg.norm(x[:, j]) for j in range(x.shape[1])]
        chosen.append(max((j for j in range(x.shape[1]) if j not in chosen), key=lambda j: scores[j]))
        fitted = np.zeros_like(x)
        for j in range(x.shape[1]):
            best = np.inf
            for size in range(len(chosen) + 1):
                for free in itertools.combinations(chosen, size):
                    a = x[:, list(free)]
                    h = np.linalg.lstsq(a, x[:, j], rcond=None)[0] if size else np.zeros(0)
                    gap = np.linalg.norm(x[:, j] - a @ h)
                    if (h >= -1e-12).all() and gap < best:
                        best, fitted[:, j] = gap, a @ h
        residual = x - fitted
    return chosen


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_extreme_columns_match_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    x = rng.random((60, 4)) @ rng.dirichlet(np.full(4, 0.4), 9).T
    x += 0.01 * rng.random(x.shape)
    want = brute_columns(x, 3)
    df = features(spark, x).repartition(4)
    for options in ({"via": "gram"}, {"via": "qr"}, {"driver_cells": 20}):
        assert fy.separable_nmf(df, 3, **options).columns == want, options
    model = fy.separable_nmf(df, 3)
    w = fy.to_numpy(model.loadings(df), "h")
    np.testing.assert_allclose(w, x[:, want])
    assert np.linalg.norm(x - w @ (model.h / model.norms)) < 0.2 * np.linalg.norm(x)


def test_ties_go_low_first_then_high():
    c = np.eye(4)
    columns, _ = X.choose_columns(c, 3)
    assert columns == [0, 3, 2]


def test_zero_columns_are_never_preferred(spark):
    x = np.array([[0.0, 1.0, 2.0], [0.0, 2.0, 1.0]])
    model = fy.separable_nmf(features(spark, x), 2, normalize=True)
    assert sorted(model.columns) == [1, 2]
    assert S.normalize_columns(features(spark, x), model.norms).first().features[0] == 0.0


def test_filters_and_columns_reach_the_scan(spark, tmp_path, table):
    path = str(tmp_path / "t")
    table.write.parquet(path)
    df = spark.read.parquet(path)
    plan = plan_of(M.row_slice(df, 10, 20).select("row_id", A.row_sum("features")))
    assert "GreaterThanOrEqual(row_id,10)" in plan and "LessThan(row_id,20)" in plan
    assert "group_id" not in plan.split("ReadSchema")[1].splitlines()[0]
    assert "Exchange" not in plan
    counts = plan_of(M.label_counts(df))
    assert "features" not in counts.split("ReadSchema")[1].splitlines()[0]


def test_maps_do_not_shuffle(table):
    for df in (
        fy.row_weights(table, np.eye(4)[:, :2]),
        fy.map_blocks(table, lambda x: x),
        fy.add_gaussian(table, 0.1),
        table.withColumn("features", A.soft_threshold("features", 0.1)),
    ):
        assert "Exchange" not in plan_of(df).split("InMemoryRelation")[0]


def test_statistics_are_combined_before_the_shuffle(table):
    plan = plan_of(G.solved_statistics(table, np.eye(4)[:, :2]))
    assert "partial_sum(value" in plan
