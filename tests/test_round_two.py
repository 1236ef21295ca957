"""Results that do not depend on size, and inputs that are refused rather than bent."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import facetry as fy
from facetry.operators import basis as B
from facetry.operators import group_stats as G
from facetry.operators import matrix as M
from facetry.operators import scoring as S
from facetry.operators import weights as W
from facetry.operators.blocks import TooLarge, block_facts
from facetry.plans.factorize import fit_basis

from .conftest import features


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    truth = rng.normal(size=(9, 3))
    x = rng.dirichlet(np.full(3, 0.5), 240) @ truth.T + 0.1 * rng.normal(size=(240, 9))
    return features(spark, x, np.arange(240) % 4).repartition(3).persist()


@pytest.mark.parametrize("solver,hyper", [("admm", 5.0), ("cease", 1.0), ("agd", 0.0)])
def test_history_does_not_depend_on_where_the_update_runs(table, solver, hyper):
    options = dict(solver=solver, lam=0.1, hyper=hyper, max_iter=2, seed=1, noise_aware=True)
    small = fy.factorize(table, 3, **options)
    wide = fy.factorize(table, 3, driver_cells=10, pool_groups=False, **options)
    assert solver == "agd" or small.history[-1][6] > 0
    for a, b in zip(small.history, wide.history):
        np.testing.assert_allclose(a[2:7], b[2:7], rtol=1e-7)
        assert a[7] == b[7] == 0
    np.testing.assert_allclose(small.basis, wide.basis, atol=1e-8)


def test_penalised_objective_follows_alpha(table):
    value = [fy.factorize(table, 3, solver="agd", alpha=a, max_iter=1, seed=1).history[0][3] for a in (0.1, (0.1, 0.1, 0.1000001))]
    assert value[0] == pytest.approx(value[1], rel=1e-5)


def test_partial_sums_are_few_rows(spark, table, monkeypatch):
    """A task sends one row per group and matrix, however many cells a matrix has."""
    monkeypatch.setattr(G, "_summed", lambda partials: partials)
    rows = G.solved_statistics(table, np.eye(9)[:, :3])
    assert rows.count() == 3 * 4 * 4
    assert "HashAggregate" not in plan_of(rows)


def test_facts_read_blocks_as_they_lie(spark, table):
    blocks = fy.pack_blocks(table.repartition(40))
    assert block_facts(blocks)[:2] == (240, 9)


def test_unconverged_rows_are_not_passed_off(spark, table):
    rng = np.random.default_rng(0)
    w = rng.normal(size=(9, 4))
    b, q = rng.normal(size=(20, 9)) @ w, w.T @ w
    with pytest.raises(W.NotConverged, match="20 of 20 rows"):
        W.simplex_minimiser(b, q, np.full(4, 0.1), max_iter=2)
    assert not W.simplex_rows(b, q, np.full(4, 0.1))[1].any()
    assert W.nonnegative_rows(b, q, max_iter=0)[1].any() and not W.nonnegative_rows(b, q)[1].any()


def test_kernel_counts_open_rows(spark, table, monkeypatch):
    real = W.simplex_rows
    monkeypatch.setattr(W, "simplex_rows", lambda b, q, alpha, eps: real(b, q, alpha, eps, max_iter=2))
    kernel = W.weight_kernel(np.random.default_rng(1).normal(size=(9, 3)), "simplex", 0.1, 1e-5)
    assert kernel(np.zeros(5, int), np.ones((5, 9)))[2].all()


@pytest.mark.parametrize("position", [None, -1, 3])
@pytest.mark.parametrize("width", [3, 300])
def test_cells_outside_the_width_are_refused(spark, position, width):
    bad = position if position != 3 else width
    rows = spark.createDataFrame([(1, 0, 2.0), (1, bad, 1.0)], "k bigint, p int, v double")
    with pytest.raises(Exception, match="at key 1"):
        fy.from_dense_rows(rows, "k", "p", "v", width).collect()


def test_wide_rows_are_assembled_alike(spark, monkeypatch):
    from facetry.sources import tables

    rows = spark.createDataFrame([(k, p, float(k + p)) for k in range(20) for p in range(k % 6)] + [(3, 1, 5.0)], "k bigint, p int, v double")
    narrow = fy.from_dense_rows(rows, "k", "p", "v", 6).orderBy("row_id").collect()
    monkeypatch.setattr(tables, "NARROW", 2)
    assert fy.from_dense_rows(rows, "k", "p", "v", 6).orderBy("row_id").collect() == narrow


def test_pairs_need_the_same_unique_keys(spark):
    table = lambda keys: spark.createDataFrame([(k, [1.0, float(k)]) for k in keys], "row_id bigint, h array<double>")
    assert M.relative_change(table([1, 2]), table([1, 2])).first()[0] == 0
    for a, b in (([1, 2, 3], [1, 2]), ([1, 1, 2], [1, 2]), ([1, 2], [1, 2, 2])):
        with pytest.raises(Exception, match="row_id"):
            M.relative_change(table(a), table(b)).collect()
        with pytest.raises(Exception, match="row_id"):
            S.label_pairs(*(table(k).select("row_id", F.lit(1).alias(n)) for k, n in ((a, "true_label"), (b, "pred_label")))).collect()
    plan = plan_of(M.combine(*(table([1]).withColumnRenamed("h", "features") for _ in range(2)), "+"))
    assert plan.count("Exchange hashpartitioning") == 2


def test_qr_route_is_refused_where_r_is_too_large(table):
    with pytest.raises(TooLarge, match="via='gram'"):
        fy.separable_nmf(table.withColumn("features", F.transform("features", F.abs)), 2, via="qr", driver_cells=10)


@pytest.mark.parametrize("tile", [2, 4, 100])
def test_gram_from_tiles(spark, table, tile):
    rows = sorted(table.select("row_id", "group_id", "features").collect())
    x, g = np.array([r.features for r in rows]), np.array([r.group_id for r in rows])
    got = np.zeros((4, 9, 9))
    for r in G.group_gram(table, tile=tile).collect():
        got[r.group_id, r.i, r.j] = r.value
    np.testing.assert_allclose(got, [x[g == k].T @ x[g == k] for k in range(4)], atol=1e-10)
    upper = G.upper_gram(table, norms=True, tile=tile, held_bytes=500).collect()
    assert len(upper) == 4 * (45 + 9)
    norms = {(r.group_id, r.i): r.value for r in upper if r.j == 9}
    np.testing.assert_allclose([norms[2, i] for i in range(9)], np.abs(x[g == 2]).sum(axis=0))


def test_class_matrices_are_checked_before_they_are_made(spark):
    diagonal = spark.range(60_000).select(F.col("id").cast("int").alias("true_label"), F.col("id").cast("int").alias("pred_label"), F.lit(1).cast("bigint").alias("n"))
    with pytest.raises(TooLarge):
        S.count_matrix(diagonal, 4_000_000, 2000)
    with pytest.raises(TooLarge):
        S.contingency(diagonal.drop("n"))


def test_rows_are_joined_once(spark):
    truth = spark.range(50).select(F.col("id").alias("row_id"), (F.col("id") % 3).cast("int").alias("true_label"))
    guess = spark.range(50).select(F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("pred_label"))
    counts = S.joint_counts(S.label_pairs(truth, guess))
    assert plan_of(counts).count("SortMergeJoin") + plan_of(counts).count("ShuffledHashJoin") == 1
    full = S.contingency(S.label_pairs(truth, guess))
    assert "Join" not in plan_of(full) and full.count() == 6


def test_labels_pass_columns_through(spark, table):
    model = fy.factorize(table, 2, solver="agd", max_iter=1, seed=1)
    named = table.withColumn("name", F.lit("x"))
    found = model.labels(named, keep=("name", "label"))
    assert found.columns == ["row_id", "name", "label", "pred_label"] and found.count() == 240
    assert "Exchange" not in plan_of(model.labels(spark.range(3).select(F.col("id").alias("row_id"), F.lit(0).alias("group_id"), F.array(*[F.lit(1.0)] * 9).alias("features"))))


def test_steps_of_a_path_are_solved_once():
    rng = np.random.default_rng(2)
    hs = [rng.dirichlet(np.ones(20), 300) for _ in range(5)]
    xs = [h @ rng.normal(size=(362, 20)).T for h in hs]
    grams, cross = np.stack([h.T @ h for h in hs]), np.stack([x.T @ h for x, h in zip(xs, hs)], axis=1)
    step = B.BasisStep("admm", 0.01, np.full(5, 0.2), 50.0, max_iter=100)
    began = time.perf_counter()
    path = step.path(cross, grams, np.zeros((362, 20)))
    assert len(path) == 100 and time.perf_counter() - began < 1.5
    short = B.BasisStep("admm", 0.01, np.full(5, 0.2), 50.0, max_iter=7)
    np.testing.assert_array_equal(path[6][0], short.solve(cross, grams, np.zeros((362, 20)))[0])


def test_errors_of_noiseless_data_do_not_cancel(spark):
    rng = np.random.default_rng(4)
    basis = 1e4 * rng.normal(size=(6, 2))
    h = rng.dirichlet(np.ones(2), 60)
    df = features(spark, h @ basis.T, np.arange(60) % 2)
    weights = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(h)], "row_id bigint, h array<double>")
    _, _, history = fit_basis(df.join(weights, "row_id"), basis * (1 + 1e-9), solver="agd", lam=0.0, inner_iter=3)
    assert all(0 <= row[2] < 1e-6 for row in history)


def test_rows_numbered_in_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(5)
    got = fy.number_rows(df, "k", "n").collect()
    assert sorted(r.n for r in got) == list(range(1000)) and all(r.n == r.k for r in got)
    assert fy.number_rows(df.limit(0), "k").count() == 0


def test_lines_numbered_by_place(spark, tmp_path):
    lines = [f"{i},{2 * i}" for i in range(1000)]
    for part in range(4):
        (tmp_path / f"part-{part}.csv").write_text("\n".join(lines[250 * part : 250 * (part + 1)]) + "\n")
    whole = fy.read_delimited(spark, str(tmp_path)).orderBy("row_id").collect()
    assert [r.row_id for r in whole] == list(range(1000)) == [int(r.features[0]) for r in whole]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        assert fy.read_delimited(spark, str(tmp_path)).orderBy("row_id").collect() == whole
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert M.row_slice(fy.read_delimited(spark, str(tmp_path)), 100, 300).count() == 200


def test_sizes_and_levels_are_validated(spark):
    from facetry.sources.planted import group_sizes

    for arguments in ((10, 10, 0.001), (1, 10, 0.5)):
        with pytest.raises(ValueError):
            group_sizes(*arguments)
    assert sum(group_sizes(10, 100, 0.4)) == 1000
    keys = spark.createDataFrame([(1, -1)], "row_id bigint, group_id int")
    with pytest.raises(Exception, match="group_id must lie"):
        fy.planted(keys, np.eye(2), sigmas=[1.0, 2.0]).collect()
