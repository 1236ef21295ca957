"""Rivals and scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

import facetry as fy
from facetry.functions import arrays as A
from facetry.operators import kmeans as KM
from facetry.operators import scoring as S
from facetry.plans import compare as C

from . import fixtures as fx
from .fixtures import EMB, EMB_CELLS, USER_CELLS, USERS, matrix_rows, r6, rounded, with_
from .least_squares import picks_sql
from .registry import query

COUNTS = """pairs AS (SELECT label AS t, ((list_position(x, list_max(x)) - 1) % 10)::INT AS p FROM emb),
  counts AS (SELECT a.t, b.p, (SELECT count(*) FROM pairs q WHERE q.t = a.t AND q.p = b.p) AS n
    FROM (SELECT DISTINCT t FROM pairs) a, (SELECT DISTINCT p FROM pairs) b)"""


def matching_sql(classes: int) -> str:
    """Best one-to-one matching by dynamic programming over sets of used predicted classes."""
    parts = [
        """cost AS (SELECT t, p, 1 / (1 + n / (SELECT sum(n) FROM counts)) AS c,
          dense_rank() OVER (ORDER BY t) - 1 AS ti, dense_rank() OVER (ORDER BY p) - 1 AS pi FROM counts)""",
        "m0 AS (SELECT 0::BIGINT AS mask, 0.0::DOUBLE AS total, []::BIGINT[] AS used)",
    ]
    for k in range(classes):
        parts.append(
            f"""m{k + 1} AS MATERIALIZED (SELECT mask, min(total) AS total, arg_min(used, total) AS used FROM (
    SELECT mask | (1::BIGINT << pi) AS mask, total + c AS total, list_append(used, pi) AS used
    FROM m{k}, cost WHERE ti = {k} AND (mask & (1::BIGINT << pi)) = 0) GROUP BY mask)"""
        )
    parts.append(
        f"""best AS (SELECT used FROM m{classes} ORDER BY total LIMIT 1),
  matched AS (SELECT cost.t, cost.p, n, sum(n) OVER () AS hit,
      (SELECT sum(n) FROM counts q WHERE q.t = cost.t) AS nt, (SELECT sum(n) FROM counts q WHERE q.p = cost.p) AS np,
      (SELECT sum(n) FROM counts) AS total
    FROM cost JOIN counts USING (t, p), best WHERE used[ti + 1] = pi)"""
    )
    return ",\n  ".join(parts)


MATCHED = [EMB, COUNTS, matching_sql(10)]


def table(spark, sf):
    df = fx.emb(spark, sf)
    truth = df.select("row_id", F.col("label").alias("true_label"))
    guess = df.select("row_id", (A.argmax("features", 0) % 10).cast("int").alias("pred_label"))
    return S.contingency(S.label_pairs(truth, guess))


@query("e1_kmeans_labels")
def kmeans_labels(spark, sf):
    return C.kmeans_labels(fx.emb(spark, sf), 10, seed=1)


@query("e1_kmeans_nearest", with_([EMB], "SELECT row_id, true AS nearest FROM emb"))
def kmeans_nearest(spark, sf):
    """Every row's label is that of the nearest mean of labelled rows, up to what K-Means' own tolerance (1e-4) moves a centre."""
    df = fx.emb(spark, sf)
    labelled = C.kmeans_labels(df, 10, seed=1, keep=("features",))
    cells = labelled.select("pred_label", F.posexplode("features").alias("i", "v")).groupBy("pred_label", "i").agg(F.avg("v").alias("v"))
    found = cells.toArrow()
    centres = np.zeros((10, 64))
    centres[found.column("pred_label").to_numpy(), found.column("i").to_numpy()] = found.column("v").to_numpy()
    table = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in centres])
    far = lambda centre: A.row_sum(F.zip_with("features", centre, lambda x, c: (x - c) * (x - c)))
    gaps = labelled.withColumn("d", F.transform(table, far))
    return gaps.select("row_id", (F.get("d", F.col("pred_label")) <= F.array_min("d") + 1e-3).alias("nearest"))


def lloyd_sql(steps: int) -> str:
    """Steps of K-Means from the four rows with the lowest draws, the distances as plain sums of squares."""
    parts = [
        f"""c0 AS (SELECT row_number() OVER (ORDER BY {fx.uniform_sql('row_id', '0', 3)}, row_id) - 1 AS k, row_id FROM emb QUALIFY k < 4),
  s0 AS MATERIALIZED (SELECT k, i, v FROM c0 JOIN emb_cells USING (row_id))"""
    ]
    for n in range(1, steps + 1):
        parts.append(
            f"""d{n} AS MATERIALIZED (SELECT row_id, k, sum(pow(e.v - s.v, 2)) AS d FROM emb_cells e JOIN s{n - 1} s USING (i) GROUP BY ALL),
  a{n} AS MATERIALIZED (SELECT row_id, arg_min(k, d) AS k FROM d{n} GROUP BY row_id),
  s{n} AS MATERIALIZED (SELECT k, i, avg(v) AS v FROM emb_cells JOIN a{n} USING (row_id) GROUP BY ALL)"""
        )
    return ",\n  ".join(parts)


@query("e1_kmeans_steps", with_([EMB, EMB_CELLS, lloyd_sql(2)], f"SELECT k::INT AS k, i, {r6('v')} AS value FROM s2"))
def kmeans_steps(spark, sf):
    """Two steps from given centres, summed block by block."""
    from facetry.plans import factorize as fit

    df = fx.emb(spark, sf)
    start = fit.initial_basis(df, 4, "random_rows", seed=3).T
    centres, _ = KM.kmeans_steps(fy.pack_blocks(df), start, max_iter=2)
    return matrix_rows(spark, centres, "k", "i")


@query("f2_kmeans_start_settled", "SELECT unnest(range(4))::INT AS k, true AS settled")
def kmeans_start_settled(spark, sf):
    """Every starting centre is the mean of the sampled rows nearest to it."""
    from facetry.plans import factorize as fit

    df = fx.emb(spark, sf)
    centres = fit.initial_basis(df, 4, "kmeans", seed=3, rows_per_centre=50).T
    sample = fit._drawn(df, 3).orderBy("draw", "row_id").limit(200)
    table = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in centres])
    far = lambda centre: A.row_sum(F.zip_with("features", centre, lambda x, c: (x - c) * (x - c)))
    near = sample.withColumn("d", F.transform(table, far)).withColumn("k", (F.array_position("d", F.array_min("d")) - 1).cast("int"))
    means = near.select("k", F.posexplode("features").alias("i", "v")).groupBy("k", "i").agg(F.avg("v").alias("v"))
    gap = F.max(F.abs(F.col("v") - F.get(F.get(table, F.col("k")), F.col("i"))))
    return means.groupBy("k").agg((gap < 0.02).alias("settled"))


@query(
    "e2_nmf_labels",
    with_(
        [USERS, USER_CELLS, picks_sql(False)],
        """SELECT a.row_id, CASE WHEN a.v >= b.v THEN 0 ELSE 1 END AS pred_label
          FROM (SELECT row_id, v FROM ue_cells JOIN s1 ON i = s) a JOIN (SELECT row_id, v FROM ue_cells JOIN s2 ON i = s) b
          USING (row_id)""",
    ),
)
def nmf_labels(spark, sf):
    return C.nmf_labels(fx.user_events(spark, sf), 2)


@query("e3_contingency", with_([EMB, COUNTS], "SELECT t AS true_label, p AS pred_label, n FROM counts"))
def contingency(spark, sf):
    return table(spark, sf)


@query("e4_matched_classes", with_(MATCHED, "SELECT t AS true_label, p AS pred_label, n FROM matched"))
def matched_classes(spark, sf):
    return S.match_classes(table(spark, sf)).select("true_label", "pred_label", "n")


@query("e4_matched_classes_auction", with_(MATCHED, f"SELECT {r6('sum(1 / (1 + n / total))')} AS cost, count(*) AS pairs FROM matched"))
def matched_classes_auction(spark, sf):
    """The total cost of the matching that the auction over the pairs that occur finds: that of the best matching."""
    matched = S.match_many_classes(table(spark, sf))
    cost = F.sum(1 / (1 + F.col("n") / F.col("total")))
    return matched.agg(rounded(cost).alias("cost"), F.count("pred_label").alias("pairs"))


@query("e5_accuracy", with_(MATCHED, f"SELECT {r6('sum(n) / max(total)')} AS accuracy FROM matched"))
def accuracy(spark, sf):
    return S.accuracy(S.match_classes(table(spark, sf))).select(rounded("accuracy").alias("accuracy"))


@query(
    "e6_f_measure",
    with_(
        MATCHED,
        f"""SELECT {r6('avg(CASE WHEN n > 0 THEN 2 * (n / np) * (n / nt) / (n / np + n / nt) END)')} AS f1,
          {r6('2 * avg(n / np) * avg(n / nt) / (avg(n / np) + avg(n / nt))')} AS f1_of_means FROM matched""",
    ),
)
def f_measure(spark, sf):
    f = S.f_measure(S.match_classes(table(spark, sf)))
    return f.select(rounded("f1").alias("f1"), rounded("f1_of_means").alias("f1_of_means"))


@query("e7_compare_methods")
def compare_methods(spark, sf):
    """Planted three-class data on the customers' keys; wall-clock seconds are left out."""
    basis = fy.banded_basis(6, 3, 1, 1.5)
    df = fy.planted(fx.customer_keys(spark, sf), basis, alpha=0.1, sigmas=[0.1] * 4 + [0.6], seed=5).persist()
    try:
        return fy.compare(df, fy.default_methods(3, seed=1, lam=0.5, max_iter=5)).drop("seconds")
    finally:
        df.unpersist()


@query("e7_methods_recover", "SELECT unnest(['kmeans', 'nmf', 'agd', 'admm', 'cease']) AS method, true AS recovers")
def methods_recover(spark, sf):
    """On well separated planted classes every method labels 9 rows of 10 right, the separable factorisation 6 of 10."""
    basis = fy.banded_basis(6, 3, 0, 1.5)
    df = fy.planted(fx.customer_keys(spark, sf), basis, alpha=0.02, sigmas=[0.05] * 5, seed=5)
    df = df.withColumn("features", A.map_cells("features", F.abs)).persist()
    try:
        found = fy.compare(df, fy.default_methods(3, seed=1, lam=0.5, init="kmeans", max_iter=5))
    finally:
        df.unpersist()
    least = F.when(F.col("method") == "nmf", 0.6).otherwise(0.9)
    return found.select("method", (F.col("accuracy") > least).alias("recovers"))


ESTIMATES = """est AS (SELECT CASE WHEN row_id % 2 = 0 THEN 'plain' ELSE 'aware' END AS method, label, i, avg(v) AS v
  FROM emb_cells GROUP BY ALL)"""


def estimates(spark, sf):
    """Mean embedding per label as ten repeats, by parity of the key as two methods."""
    method = F.when(F.col("row_id") % 2 == 0, "plain").otherwise("aware")
    long = fx.emb(spark, sf).select(method.alias("method"), F.col("label").alias("run"), F.posexplode("features").alias("i", "v"))
    return long.groupBy("method", "run", "i").agg(F.avg("v").alias("value")).withColumn("j", F.lit(0))


@query(
    "e8_cell_variances",
    with_([EMB, EMB_CELLS, ESTIMATES], f"SELECT method, i, 0 AS j, {r6('var_samp(v)', 9)} AS variance FROM est GROUP BY method, i"),
)
def cell_variances(spark, sf):
    return C.cell_variances(estimates(spark, sf)).withColumn("variance", rounded("variance", 9))


@query(
    "e8_variance_ratio",
    with_(
        [EMB, EMB_CELLS, ESTIMATES, "cv AS (SELECT method, i, var_samp(v) AS s FROM est GROUP BY method, i)"],
        f"SELECT {r6('''avg(s) FILTER (method = 'aware') / avg(s) FILTER (method = 'plain')''')} AS ratio FROM cv",
    ),
)
def variance_ratio(spark, sf):
    return C.variance_ratio(estimates(spark, sf)).select(rounded("ratio").alias("ratio"))


@query("e8_ratio_in_band", "SELECT true AS lower, true AS in_band")
def ratio_in_band(spark, sf):
    """Over 40 repeats noise-aware weights lower the variance, by a ratio within a factor of two of theory."""
    basis = fy.banded_basis(6, 3, 1, 1.5)
    found = fy.variance_experiment(fx.customer_keys(spark, sf), basis, [1.0, 1.0, 1.0, 1.0, 4.0], 40)
    theory = float(found.theory_aware.mean() / found.theory_plain.mean())
    ratio = C.variance_ratio(found.estimates)
    return ratio.select((F.col("ratio") < 1).alias("lower"), F.col("ratio").between(theory / 2, theory * 2).alias("in_band"))


@query("e8_variance_experiment")
def variance_experiment(spark, sf):
    """Noise-aware against plain estimates on planted data: empirical ratio and the theoretical one."""
    basis = fy.banded_basis(6, 3, 1, 1.5)
    found = fy.variance_experiment(fx.customer_keys(spark, sf), basis, [1.0, 1.0, 1.0, 1.0, 4.0], 10)
    theory = float(found.theory_aware.mean() / found.theory_plain.mean())
    return C.variance_ratio(found.estimates).select(
        rounded("ratio").alias("empirical"), rounded(F.lit(theory)).alias("theoretical")
    )
