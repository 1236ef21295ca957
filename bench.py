"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default all cores) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import facetry as fy  # noqa: E402
from catalog import QUERIES  # noqa: E402
from catalog import fixtures as fx  # noqa: E402


def planted_rows(spark, sf):
    keys = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"))
    keys = fy.assign_groups(keys, 10, F.col("row_id") % 10).repartition(spark.sparkContext.defaultParallelism, "row_id")
    return fy.planted(keys, fy.normal_basis(100, 2, scale=2.0, seed=1), alpha=0.1, seed=2)


def timing_table(spark, sf):
    """The default timing workload on the orders' keys: 10 groups, 100 features, rank 2, Dirichlet .1."""
    return fy.pack_blocks(planted_rows(spark, sf)).persist()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", os.environ.get("BENCH_CPUS", "8"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    fy.ship_package(spark)

    table = timing_table(spark, sf)
    rows = table.agg(F.sum("n")).first()[0]
    lam = 1e-3 * rows / 10
    start = fy.normal_basis(100, 2, scale=2.0, seed=3)
    solvers = {"agd": 0.0, "admm": 300.0, "cease": 1e-4}

    def fit(solver, hyper):
        fy.factorize(table, 2, solver=solver, lam=lam, hyper=hyper, init=start, max_iter=5)

    def loss_curve():
        """100 ADMM steps for known weights: banded basis of 362 features, rank 20, 5 groups, on the customers' keys."""
        basis = fy.banded_basis(20, 20, 2, 1.5)
        data = fy.planted(fx.customer_keys(spark, sf), basis, weights="bernoulli", p=1 / 19, sigmas=[1.0] * 5, seed=4)
        fy.fit_basis(data, fy.normal_basis(*basis.shape, scale=1.0, seed=5), lam=0.01, hyper=50.0, inner_iter=100, truth=basis)

    def variance_ratio():
        """Plain and noise-aware estimates over 10 repeats of the noise, last group's noise four times the others'."""
        found = fy.variance_experiment(fx.customer_keys(spark, sf), fy.banded_basis(20, 10, 2, 1.5), [1.0] * 4 + [4.0], 10)
        found.estimates.write.format("noop").mode("overwrite").save()

    jobs = {f"timing_{s}": (lambda s=s, h=h: fit(s, h)) for s, h in solvers.items()}
    jobs |= {
        "fit_lineitem_end_to_end": lambda: fy.factorize(fx.order_sales(spark, sf), 3, solver="agd", lam=0.1, max_iter=3, seed=1),
        "fit_planted_end_to_end": lambda: fy.factorize(planted_rows(spark, sf), 2, solver="admm", lam=lam, hyper=300.0, max_iter=2, seed=1),
        "loss_curve_100_steps": loss_curve,
        "variance_ratio_10_repeats": variance_ratio,
    }
    named = [
        "f21_fit_labels", "f21_nonnegative_fit", "f5_simplex_weights_r2", "a5_reduce_columns", "a8_group_gram",
        "a8_cross_gram", "n1_tsqr_gram", "n1_tsqr_factor", "n3_thin_q", "n7_nmf_loadings", "n10_ridge", "s11_row_mixture",
        "x4_add_subtract", "x5_soft_threshold", "p7_exact_sample", "e1_kmeans_labels", "e4_matched_classes", "e6_f_measure",
    ]
    for name in named:
        jobs[name] = lambda name=name: QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()

    QUERIES["p5_map_blocks"](spark, sf).write.format("noop").mode("overwrite").save()  # start the Python workers
    seconds = {}
    for name, job in jobs.items():
        began = time.perf_counter()
        job()
        seconds[name] = round(time.perf_counter() - began, 3)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {"metric": "headline_queries", "value": total, "unit": "sec", "queries": seconds, "sf": Path(sf).name, "timing_rows": rows}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
