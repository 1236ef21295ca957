"""Readers, planted data and noise."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import facetry as fy
from facetry.functions import counter
from facetry.sources import delimited, noise, planted, tables

from .conftest import features


def keys(spark, n, groups=3):
    return fy.assign_groups(spark.range(n).withColumnRenamed("id", "row_id"), groups, F.col("row_id") % groups)


def test_read_labelled_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1.0,0.5,2\n-2.9,1e-3,-4\n")
    rows = fy.read_delimited(spark, str(tmp_path), ",", has_label=True).orderBy("row_id").collect()
    assert [(r.label, r.features) for r in rows] == [(1, [0.5, 2.0]), (-2, [0.001, -4.0])]


def test_read_unlabelled_text_with_regex_delimiter(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 |2|3||\n4| 5 |6\n")
    rows = fy.read_delimited(spark, str(tmp_path), r"\|").orderBy("row_id").collect()
    assert [(r.label, r.features) for r in rows] == [(-1, [1.0, 2.0, 3.0]), (-1, [4.0, 5.0, 6.0])]


def test_bad_number_raises(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,x\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        fy.read_delimited(spark, str(tmp_path)).collect()


def test_basis_round_trip(spark, tmp_path):
    w = np.random.default_rng(0).normal(size=(7, 3))
    path = str(tmp_path / "basis")
    fy.write_basis(tables.basis_table(spark, w), path)
    back = fy.to_numpy(fy.read_delimited(spark, path, " "))
    np.testing.assert_array_equal(back, w)


def test_hash_groups_cover_all_rows(spark):
    df = fy.assign_groups(spark.range(1000).withColumnRenamed("id", "row_id"), 4)
    sizes = {r.group_id: r["count"] for r in df.groupBy("group_id").count().collect()}
    assert sorted(sizes) == [0, 1, 2, 3] and min(sizes.values()) > 150


def test_a_large_group_is_spread(spark):
    """Group 0 holds most rows: it must be split, and small groups must stay together."""
    ids = spark.range(4000).withColumnRenamed("id", "row_id")
    df = fy.assign_groups(ids, 0, F.when(F.col("row_id") < 3000, F.lit(0)).otherwise(F.col("row_id") % 200))
    spread = fy.spread_groups(df, 8).withColumn("part", F.spark_partition_id())
    assert spread.count() == 4000
    held = spread.groupBy("group_id").agg(F.countDistinct("part").alias("parts")).collect()
    parts = {r.group_id: r.parts for r in held}
    assert parts[0] >= 6
    assert all(v == 1 for g, v in parts.items() if g != 0)
    assert max(r["count"] for r in spread.groupBy("part").count().collect()) < 2000


def test_group_sizes():
    assert planted.group_sizes(3, 10) == [10, 10, 10]
    assert planted.group_sizes(4, 10, 0.5) == [40 - 3 * 7, 7, 7, 7]
    with pytest.raises(ValueError):
        planted.group_sizes(3, 10, 1.5)


def test_grouped_keys(spark):
    rows = planted.grouped_keys(spark, [3, 1, 2]).orderBy("row_id").collect()
    assert [(r.row_id, r.group_id) for r in rows] == [(0, 0), (1, 0), (2, 0), (3, 1), (4, 2), (5, 2)]


def test_planted_does_not_depend_on_layout(spark):
    basis = fy.banded_basis(4, 3, 1)
    for weights in ("dirichlet", "bernoulli"):
        a = fy.to_numpy(fy.planted(keys(spark, 50).repartition(1), basis, weights=weights, sigmas=[0.1] * 3, seed=3))
        b = fy.to_numpy(fy.planted(keys(spark, 50).repartition(6), basis, weights=weights, sigmas=[0.1] * 3, seed=3))
        np.testing.assert_allclose(a, b, atol=1e-12)


def test_planted_is_an_exact_product(spark):
    basis = fy.normal_basis(6, 3, seed=1)
    made = fy.planted(keys(spark, 80), basis, alpha=[0.1, 1.0, 5.0], seed=2)
    h = fy.to_numpy(made, "h")
    np.testing.assert_allclose(h.sum(axis=1), 1.0)
    np.testing.assert_allclose(fy.to_numpy(made), h @ basis.T, atol=1e-12)
    labels = [r.label for r in made.orderBy("row_id").collect()]
    assert labels == (h.argmax(axis=1) + 1).tolist()


def test_unknown_weights(spark):
    with pytest.raises(ValueError):
        fy.planted(keys(spark, 2), np.eye(2), weights="other")


def test_banded_basis():
    w = fy.banded_basis(4, 3, 1, 2.0)
    assert w.shape == (10, 3)
    assert (w[:4, 0] == 2.0).all() and w[4:, 0].sum() == 0
    assert w[3, 1] == 2.0 and w.sum() == 24.0


def test_bernoulli_rows_sum_to_one():
    h = planted.bernoulli_weights(np.arange(500), 4, 0.1, seed=1)
    np.testing.assert_allclose(h.sum(axis=1), 1.0)
    assert (h[:, -1] == 1.0).mean() > 0.5


def test_moments_of_the_counter_draws():
    rows, slots = np.arange(20000)[:, None], np.arange(3)[None, :]
    u = counter.uniform(rows, slots, 1)
    assert abs(u.mean() - 0.5) < 0.01 and abs(u.var() - 1 / 12) < 0.005
    assert abs(np.corrcoef(u.T)[0, 1]) < 0.02
    n = counter.normal(rows, slots, 1)
    assert abs(n.mean()) < 0.02 and abs(n.std() - 1) < 0.02
    for alpha in (0.1, 0.7, 1.0, 4.0):
        g = np.exp(counter.log_gamma_variates(rows, slots, np.array([alpha]), 5))
        assert abs(g.mean() - alpha) < 0.05 * max(alpha, 0.5)
        assert abs(g.var() - alpha) < 0.12 * max(alpha, 0.5)
    d = counter.dirichlet(np.arange(20000), np.array([0.1, 0.1, 0.8]), 5)
    np.testing.assert_allclose(d.mean(axis=0), [0.1, 0.1, 0.8], atol=0.01)


def test_random_matrix_keeps_every_key(spark):
    m = fy.to_numpy(fy.random_matrix(keys(spark, 103).repartition(7), 4, seed=1))
    assert m.shape == (103, 4) and 0 < m.min() and m.max() < 1


def test_noise_levels(spark):
    levels = spark.range(20).select(F.col("id").cast("int").alias("group_id")).select(
        "group_id", noise.group_noise_level((1.0, 2.0, 3.0), (3, 6, 1), 20).alias("sd")
    )
    sds = [r.sd for r in levels.orderBy("group_id").collect()]
    assert sds == [1.0] * 6 + [2.0] * 12 + [3.0] * 2
    rows = keys(spark, 5000).select(noise.row_noise_level((1.0, 2.0, 3.0)).alias("sd"))
    counts = {r.sd: r["count"] for r in rows.groupBy("sd").count().collect()}
    assert abs(counts[1.0] / 5000 - 0.3) < 0.03 and abs(counts[3.0] / 5000 - 0.1) < 0.02


def test_noise_has_the_given_size(spark):
    df = features(spark, np.zeros((2000, 5)))
    x = fy.to_numpy(fy.add_gaussian(df, 0.5, seed=1))
    assert abs(x.std() - 0.5) < 0.02
    np.testing.assert_array_equal(fy.to_numpy(fy.add_gaussian(df, 0.0)), 0.0)
    assert noise.group_preset(2.0) == ((0.0, 0.0, 2.0), (3, 6, 1))
    assert noise.row_preset(2.0) == ((0.0, 0.0, 2.0), (0.3, 0.3, 0.4))


def test_dense_rows_fill_gaps(spark):
    long = spark.createDataFrame([(1, 0, 2.0), (1, 2, 3.0), (1, 2, 1.0), (2, 1, 5.0)], "k int, p int, v double")
    rows = fy.from_dense_rows(long, "k", "p", "v", 3).orderBy("row_id").collect()
    assert [r.features for r in rows] == [[2.0, 0.0, 4.0], [0.0, 5.0, 0.0]]


def test_collecting_too_much_raises(spark):
    from facetry.operators.blocks import TooLarge

    with pytest.raises(TooLarge):
        fy.to_numpy(features(spark, np.zeros((10, 3))), max_cells=29)


def test_null_cells_are_refused(spark):
    df = spark.createDataFrame([(1, 0, [1.0, None])], "row_id bigint, group_id int, features array<double>")
    with pytest.raises(Exception, match="nulls"):
        fy.map_blocks(df, lambda x: x).collect()
