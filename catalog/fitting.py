"""Weights, basis updates and fits of the embeddings, mostly at rank 1 or 2 where SQL can follow."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

import facetry as fy
from facetry.functions import arrays as A
from facetry.operators import basis as B
from facetry.operators import group_stats as G
from facetry.operators import keyed_groups as K
from facetry.operators import matrix as M
from facetry.operators.blocks import small_table
from facetry.operators.weights import row_weights
from facetry.plans import factorize as fit
from facetry.plans import wide_fit

from . import fixtures as fx
from .aggregates import CROSS, VARIANCE_CTES, state_at_parity
from .fixtures import EMB, EMB_CELLS, EMB_H, PARITY, cells, matrix_rows, r6, rounded, soft_sql, with_
from .registry import query

LAM, RHO, GAMMA = 0.5, 5.0, 2.0


def flagship(spark, sf):
    """Fit the embeddings at rank 4 and label every row: ``vec_id, label, pred_label``."""
    df = fx.emb(spark, sf)
    model = fy.factorize(df, 4, solver="agd", lam=0.1, alpha=0.1, max_iter=2, seed=1)
    return model.labels(df, keep=("label",)).withColumnRenamed("row_id", "vec_id")


# --- starts -----------------------------------------------------------------------------------


RANDOM_ROWS = with_(
    [
        EMB,
        f"""picked AS (SELECT row_id, x, row_number() OVER (ORDER BY {fx.uniform_sql('row_id', '0', 3)}, row_id) AS k
          FROM emb QUALIFY k <= 4)""",
    ],
    f"SELECT unnest(range(len(x)))::INT AS i, (k - 1)::INT AS k, {r6('unnest(x)')} AS value FROM picked",
)


@query("f1_random_rows", RANDOM_ROWS)
def random_rows(spark, sf):
    return matrix_rows(spark, fit.initial_basis(fx.emb(spark, sf), 4, "random_rows", seed=3), "i", "k")


@query("f1_random_rows_packed", RANDOM_ROWS)
def random_rows_packed(spark, sf):
    """The same rows from packed blocks, which a fit draws from."""
    blocks = fy.pack_blocks(fx.emb(spark, sf), block_bytes=64 * 8 * 50)
    return matrix_rows(spark, fit._initial_basis_of_blocks(blocks, 0, 64, 4, "random_rows", 3), "i", "k")


@query("f2_kmeans_start")
def kmeans_start(spark, sf):
    return matrix_rows(spark, fit.initial_basis(fx.emb(spark, sf), 4, "kmeans", seed=3), "i", "k")


@query(
    "f3_normal_start",
    f"""SELECT i::INT AS i, k::INT AS k, {r6(fx.normal_sql('i', 'k', 3))} AS value
      FROM (SELECT unnest(range(max(len(embedding)))) AS i FROM embeddings), unnest(range(4)) AS u(k)""",
)
def normal_start(spark, sf):
    return matrix_rows(spark, fit.initial_basis(fx.emb(spark, sf), 4, "normal", seed=3), "i", "k")


# --- weights ----------------------------------------------------------------------------------


def quadratic_sql(name: str, basis: str) -> str:
    """Per row b = W'x and the shared Q = W'W for a two-column basis."""
    return f"""{name}_q AS (SELECT sum(w1 * w1) AS q11, sum(w1 * w2) AS q12, sum(w2 * w2) AS q22 FROM {basis}),
  {name}_b AS (SELECT row_id, sum(v * w1) AS b1, sum(v * w2) AS b2 FROM emb_cells JOIN {basis} USING (i) GROUP BY row_id)"""


def simplex_sql(name: str, basis: str, alpha: float) -> str:
    """h = (t, 1 - t) by bisection of the monotone derivative. -- recursive"""
    return f"""{quadratic_sql(name, basis)},
  {name}_t AS ( -- recursive
    SELECT 0 AS k, row_id, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, q11 - 2 * q12 + q22 AS d, b1 - b2 - q12 + q22 AS e
    FROM {name}_b, {name}_q
    UNION ALL
    SELECT k + 1, row_id, CASE WHEN f > 0 THEN lo ELSE m END, CASE WHEN f > 0 THEN m ELSE hi END, d, e
    FROM (SELECT *, (lo + hi) / 2 AS m,
        d * (lo + hi) / 2 - e - {alpha} / ((lo + hi) / 2) + {alpha} / (1 - (lo + hi) / 2) AS f
      FROM {name}_t WHERE k < 58)),
  {name} AS (SELECT row_id, greatest((lo + hi) / 2, 1e-5) AS h1, greatest(1 - (lo + hi) / 2, 1e-5) AS h2
    FROM {name}_t WHERE k = 58)"""


@query(
    "f5_simplex_weights_r2",
    with_(
        [EMB, EMB_CELLS, PARITY, simplex_sql("h", "parity", 0.1)],
        f"SELECT row_id, unnest([0, 1])::INT AS i, {r6('unnest([h1, h2])')} AS value FROM h",
    ),
)
def simplex_weights_r2(spark, sf):
    return cells(row_weights(fx.emb(spark, sf), fx.parity_means(spark, sf), "simplex", 0.1), "h")


@query("f5_simplex_optimality", with_([EMB], "SELECT row_id, 1.0::DOUBLE AS total, true AS optimal FROM emb"))
def simplex_optimality(spark, sf):
    """Rank 8: the weights sum to one and every component has the same slope."""
    df = fx.emb(spark, sf)
    basis = fit.initial_basis(df, 8, "random_rows", seed=3)
    q = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in basis.T @ basis])
    projected = fy.map_blocks(df.select("row_id", "features"), lambda x: x @ basis)
    rows = row_weights(df, basis, "simplex", 0.1).join(projected, "row_id")
    slope = F.transform(
        q, lambda qk, k: A.row_sum(F.zip_with(qk, F.col("h"), lambda a, b: a * b)) - F.get("features", k) - 0.1 / F.get("h", k)
    )
    spread = F.array_max("slope") - F.array_min("slope")
    return rows.withColumn("slope", slope).select(
        "row_id", rounded(A.row_sum("h")).alias("total"), (spread < 1e-4).alias("optimal")
    )


@query(
    "f6_nonnegative_weights_r2",
    with_(
        [EMB, EMB_CELLS, PARITY, quadratic_sql("n", "parity")],
        f"""SELECT row_id, unnest([0, 1])::INT AS i, {r6('''unnest(CASE
            WHEN q22 * b1 - q12 * b2 >= 0 AND q11 * b2 - q12 * b1 >= 0
              THEN [(q22 * b1 - q12 * b2) / (q11 * q22 - q12 * q12), (q11 * b2 - q12 * b1) / (q11 * q22 - q12 * q12)]
            WHEN pow(greatest(b1, 0), 2) / q11 >= pow(greatest(b2, 0), 2) / q22 THEN [greatest(b1, 0) / q11, 0.0]
            ELSE [0.0, greatest(b2, 0) / q22] END)''')} AS value FROM n_b, n_q""",
    ),
)
def nonnegative_weights_r2(spark, sf):
    return cells(row_weights(fx.emb(spark, sf), fx.parity_means(spark, sf), "nonnegative"), "h")


# --- statistics -------------------------------------------------------------------------------

GS = """gs AS (
  SELECT group_id AS c, count(*) AS n, sum(h1) AS s1, sum(h2) AS s2,
    sum(h1 * h1) AS g11, sum(h1 * h2) AS g12, sum(h2 * h2) AS g22 FROM emb_h GROUP BY group_id)"""
PS = """ps AS (
  SELECT group_id AS c, i, sum(v * h1) AS p1, sum(v * h2) AS p2
  FROM (SELECT group_id, h1, h2, unnest(range(len(x)))::INT AS i, unnest(x) AS v FROM emb_h) GROUP BY ALL)"""
OMEGA = "om AS (SELECT group_id AS c, (1 / var) / sum(1 / var) OVER () AS omega FROM vars)"
EQUAL = "om AS (SELECT c, 1.0::DOUBLE / count(*) OVER () AS omega FROM gs)"
STATS = [*VARIANCE_CTES, GS, PS]


@query(
    "f7_rescaled_groups",
    with_(
        [EMB, EMB_H, GS, CROSS],
        f"""SELECT 'P' AS part, group_id, i, j, {r6('value / (CASE WHEN j = 0 THEN s1 ELSE s2 END * 2 / n)')} AS value
          FROM crossed JOIN gs ON c = group_id
        UNION ALL SELECT 'G', c, unnest([0, 0, 1, 1])::INT, unnest([0, 1, 0, 1])::INT,
          {r6('''unnest([g11 / pow(s1 * 2 / n, 2), g12 / (s1 * 2 / n) / (s2 * 2 / n),
            g12 / (s1 * 2 / n) / (s2 * 2 / n), g22 / pow(s2 * 2 / n, 2)])''')} FROM gs""",
    ),
)
def rescaled_groups(spark, sf):
    state, _, _ = fit.known_weights_state(fx.emb_h(spark, sf))
    scaled, _ = G.rescale_groups(state, "group")
    p = matrix_rows(spark, scaled.cross, "i", "group_id", "j").withColumn("part", F.lit("P"))
    g = matrix_rows(spark, scaled.gram, "group_id", "i", "j").withColumn("part", F.lit("G"))
    return p.unionByName(g)


@query("f8_noise_variance", with_(VARIANCE_CTES, f"SELECT group_id, {r6('var', 9)} AS variance FROM vars"))
def noise_variance(spark, sf):
    state, _ = state_at_parity(spark, sf)
    rows = list(zip(state.groups.tolist(), state.variances.tolist()))
    return small_table(spark, rows, "group_id int, variance double").withColumn("variance", rounded("variance", 9))


@query(
    "f9_relative_change",
    with_(
        [EMB],
        f"""SELECT {r6('sqrt(sum(2 * pow((a - b) / 16, 2))) / sqrt(sum(pow((a / 8 + 1) / 2, 2) + pow((1 - a / 8) / 2, 2)))')}
          AS relative_change FROM (SELECT list_sum(x) AS a, list_sum(list_transform(x, lambda v, i: CASE WHEN i % 2 = 1 THEN v ELSE -v END)) AS b FROM emb)""",
    ),
)
def relative_change(spark, sf):
    old = fx.emb_h(spark, sf)
    signed = F.transform("features", lambda x, i: F.when(i % 2 == 0, x).otherwise(-x))
    t = (F.aggregate(signed, F.lit(0.0), lambda a, x: a + x) / 8 + 1) / 2
    new = old.withColumn("h", F.array(t, 1 - t))
    return M.relative_change(old, new).select(rounded("relative_change").alias("relative_change"))


# --- basis updates ----------------------------------------------------------------------------

TOP = "((g11 + g22 + sqrt(pow(g11 - g22, 2) + 4 * g12 * g12)) / 2)"
TOTALS = f"""tot AS (SELECT *, {TOP} AS top FROM (
    SELECT sum(omega * g11) AS g11, sum(omega * g12) AS g12, sum(omega * g22) AS g22, count(*) AS groups
    FROM gs JOIN om USING (c))),
  pt AS (SELECT i, sum(omega * p1) AS p1, sum(omega * p2) AS p2 FROM ps JOIN om USING (c) GROUP BY i)"""


def descent_sql(name: str, start: str, lam: float, steps: int, momentum: str, totals: str = "tot", cross: str = "pt") -> str:
    """Proximal gradient with an L1 term for all features at once."""
    t_next = {"damped": "0.5 + sqrt(1 + 4 * t * t)", "standard": "0.5 * (1 + sqrt(1 + 4 * t * t))", "none": "1.0"}[momentum]
    factor = "0.0" if momentum == "none" else f"((t - 1) / ({t_next}))"
    cut = f"({lam} / groups / top)"
    return f"""{name}_r AS ( -- recursive
    SELECT 0 AS k, i, w1, w2, w1 AS y1, w2 AS y2, 1.0::DOUBLE AS t FROM {start}
    UNION ALL
    SELECT k + 1, i, n1, n2, n1 + (n1 - w1) * {factor}, n2 + (n2 - w2) * {factor}, ({t_next})::DOUBLE
    FROM (SELECT r.*, {soft_sql('y1 - (y1 * g11 + y2 * g12 - p1) / top', cut)} AS n1,
        {soft_sql('y2 - (y1 * g12 + y2 * g22 - p2) / top', cut)} AS n2
      FROM {name}_r r JOIN {cross} USING (i), {totals} WHERE k < {steps})),
  {name} AS (SELECT i, w1, w2 FROM {name}_r WHERE k = {steps})"""


def basis_out(name: str) -> str:
    return f"SELECT i, unnest([0, 1])::INT AS k, {r6('unnest([w1, w2])')} AS value FROM {name}"


def step_at_parity(spark, sf, solver: str, *, aware: bool, lam: float = LAM, hyper: float = 0.0, **options):
    state, start = state_at_parity(spark, sf)
    c = len(state.groups)
    omega = B.precision_weights(state.variances) if aware else np.full(c, 1.0 / c)
    return B.BasisStep(solver, lam, omega, hyper, **options).solve(state.cross, state.gram, start)


def wide_step_at_parity(spark, sf, solver: str, *, aware: bool = True, **options):
    """(W, violation) of the same step as ``step_at_parity``, made in Spark from statistics that stay there, three features to a block."""
    df, start = fx.emb_h(spark, sf), fx.parity_means(spark, sf)
    stats = G.weighted_statistics(df, start)
    state = G.read_state(stats, G.group_ids(df), 64, 2, with_cross=False)
    c = len(state.groups)
    omega = B.precision_weights(G.noise_variances(state, 64)) if aware else np.full(c, 1.0 / c)
    return B.update_wide_basis(stats, state, B.BasisStep(solver, LAM, omega, **options), start, block_cells=3 * 2 * c)


def keyed_step_at_parity(spark, sf, solver: str, **options):
    """(W, violation) of the same step from groups as keyed rows, twelve features to a row: no group's matrices reach the driver."""
    start = fx.parity_means(spark, sf)
    keyed = K.keyed_groups(G.weighted_partials(fx.emb_h(spark, sf), start), 64, 2, block_cells=24)
    state, _, _ = K.keyed_state(keyed, 2)
    shares = K.Shares(len(state.groups), 64, float((1.0 / G.noise_variances(state, 64)).sum()))
    found = K.update_keyed_basis(keyed, B.BasisStep(solver, LAM, np.ones(1), **options), start, shares)
    return found.basis, found.violation


AGD_STEP = with_([*STATS, OMEGA, TOTALS, descent_sql("w", "parity", LAM, 35, "damped")], basis_out("w"))


@query("f10_agd_step", AGD_STEP)
def agd_step(spark, sf):
    return matrix_rows(spark, step_at_parity(spark, sf, "agd", aware=True)[0], "i", "k")


@query("f10_agd_pooled", AGD_STEP)
def agd_pooled(spark, sf):
    """The same step with the groups added up in Spark."""
    start = fx.parity_means(spark, sf)
    stats = G.weighted_statistics(fx.emb_h(spark, sf), start)
    state, share = G.pooled_state(stats, 64, 2, noise_aware=True)
    w, _ = B.BasisStep("agd", LAM / len(share), np.ones(1)).solve(state.cross, state.gram, start)
    return matrix_rows(spark, w, "i", "k")


ADMM_INVERSE = f"""inv AS (SELECT c, a, b, d, a * d - b * b AS det FROM (
    SELECT c, 1 + g11 / {RHO} AS a, g12 / {RHO} AS b, 1 + g22 / {RHO} AS d FROM gs)),
  w0 AS (SELECT i, w1, w2 FROM parity),
  u0 AS (SELECT c, i, 0.0::DOUBLE AS u1, 0.0::DOUBLE AS u2 FROM ps)"""


def admm_sql(steps: int, lam: float) -> str:
    parts = [ADMM_INVERSE]
    for k in range(1, steps + 1):
        parts.append(
            f"""v{k} AS MATERIALIZED (SELECT c, i, u1, u2, (z1 * d - z2 * b) / det AS v1, (z2 * a - z1 * b) / det AS v2
    FROM (SELECT c, i, u1, u2, p1 / {RHO} + w1 - u1 AS z1, p2 / {RHO} + w2 - u2 AS z2
      FROM ps JOIN u{k - 1} USING (c, i) JOIN w{k - 1} USING (i)) JOIN inv USING (c)),
  w{k} AS MATERIALIZED (SELECT i, {soft_sql('a1', 'cut')} AS w1, {soft_sql('a2', 'cut')} AS w2 FROM (
    SELECT i, sum(omega * (v1 + u1)) AS a1, sum(omega * (v2 + u2)) AS a2, {lam} / count(*) / {RHO} AS cut
    FROM v{k} JOIN om USING (c) GROUP BY i)),
  u{k} AS MATERIALIZED (SELECT c, i, u1 + v1 - w1 AS u1, u2 + v2 - w2 AS u2 FROM v{k} JOIN w{k} USING (i))"""
        )
    return ",\n  ".join(parts)


ADMM_STEP = with_([*STATS, OMEGA, admm_sql(10, LAM)], basis_out("w10"))


@query("f11_admm_step", ADMM_STEP)
def admm_step(spark, sf):
    return matrix_rows(spark, step_at_parity(spark, sf, "admm", aware=True, hyper=RHO)[0], "i", "k")


@query("f11_admm_step_wide", ADMM_STEP)
def admm_step_wide(spark, sf):
    return matrix_rows(spark, wide_step_at_parity(spark, sf, "admm", hyper=RHO)[0], "i", "k")


@query("f11_admm_step_keyed", ADMM_STEP)
def admm_step_keyed(spark, sf):
    return matrix_rows(spark, keyed_step_at_parity(spark, sf, "admm", hyper=RHO)[0], "i", "k")


REGULAR = f"""reg AS (SELECT *, g11 * g22 - g12 * g12 AS det, {TOP} AS top FROM (
    SELECT c, g11 + {GAMMA} AS g11, g12, g22 + {GAMMA} AS g22 FROM gs)),
  w0 AS (SELECT i, w1, w2 FROM parity)"""


def gradients_sql(k: int) -> str:
    return f"""own{k} AS MATERIALIZED (SELECT c, i, w1 * g11 + w2 * g12 - p1 AS o1, w1 * g12 + w2 * g22 - p2 AS o2
    FROM ps JOIN gs USING (c) JOIN w{k - 1} USING (i)),
  all{k} AS MATERIALIZED (SELECT i, sum(omega * o1) AS s1, sum(omega * o2) AS s2 FROM own{k} JOIN om USING (c) GROUP BY i)"""


def smooth_cease_sql(steps: int) -> str:
    parts = [REGULAR]
    for k in range(1, steps + 1):
        parts.append(
            f"""{gradients_sql(k)},
  w{k} AS MATERIALIZED (SELECT i, sum(omega * (w1 - (s1 * g22 - s2 * g12) / det)) AS w1,
      sum(omega * (w2 - (s2 * g11 - s1 * g12) / det)) AS w2
    FROM all{k} JOIN w{k - 1} USING (i), reg JOIN om USING (c) GROUP BY i)"""
        )
    return ",\n  ".join(parts)


@query("f12_cease_smooth", with_([*STATS, OMEGA, smooth_cease_sql(5)], basis_out("w5")))
def cease_smooth(spark, sf):
    return matrix_rows(spark, step_at_parity(spark, sf, "cease", aware=True, lam=0.0, hyper=GAMMA)[0], "i", "k")


def cease_sql(steps: int, inner: int, lam: float) -> str:
    parts = [REGULAR]
    factor = "((t - 1) / (0.5 + sqrt(1 + 4 * t * t)))"
    for k in range(1, steps + 1):
        parts.append(
            f"""{gradients_sql(k)},
  rhs{k} AS MATERIALIZED (SELECT c, i, w1, w2, p1 + {GAMMA} * w1 + o1 - s1 AS q1, p2 + {GAMMA} * w2 + o2 - s2 AS q2
    FROM ps JOIN own{k} USING (c, i) JOIN all{k} USING (i) JOIN w{k - 1} USING (i)),
  in{k} AS ( -- recursive
    SELECT 0 AS n, c, i, w1 AS v1, w2 AS v2, w1 AS y1, w2 AS y2, 1.0::DOUBLE AS t FROM rhs{k}
    UNION ALL
    SELECT n + 1, c, i, n1, n2, n1 + (n1 - v1) * {factor}, n2 + (n2 - v2) * {factor}, 0.5 + sqrt(1 + 4 * t * t)
    FROM (SELECT r.*, {soft_sql('y1 - (y1 * g11 + y2 * g12 - q1) / top', f'{lam} / groups / top')} AS n1,
        {soft_sql('y2 - (y1 * g12 + y2 * g22 - q2) / top', f'{lam} / groups / top')} AS n2
      FROM in{k} r JOIN rhs{k} USING (c, i) JOIN reg USING (c), (SELECT count(*) AS groups FROM gs) WHERE n < {inner})),
  w{k} AS MATERIALIZED (SELECT i, sum(omega * v1) AS w1, sum(omega * v2) AS w2
    FROM in{k} JOIN om USING (c) WHERE n = {inner} GROUP BY i)"""
        )
    return ",\n  ".join(parts)


CEASE_L1 = with_([*STATS, OMEGA, cease_sql(5, 20, LAM)], basis_out("w5"))


@query("f13_cease_l1", CEASE_L1)
def cease_l1(spark, sf):
    return matrix_rows(spark, step_at_parity(spark, sf, "cease", aware=True, hyper=GAMMA)[0], "i", "k")


@query("f13_cease_l1_wide", CEASE_L1)
def cease_l1_wide(spark, sf):
    return matrix_rows(spark, wide_step_at_parity(spark, sf, "cease", hyper=GAMMA)[0], "i", "k")


@query("f13_cease_l1_keyed", CEASE_L1)
def cease_l1_keyed(spark, sf):
    return matrix_rows(spark, keyed_step_at_parity(spark, sf, "cease", hyper=GAMMA)[0], "i", "k")


@query(
    "f14_central_descent",
    with_(
        [*STATS, EQUAL, TOTALS, descent_sql("a", "parity", LAM, 35, "none"), descent_sql("b", "parity", LAM, 35, "standard")],
        f"""SELECT 'ista' AS method, * FROM ({basis_out('a')}) UNION ALL SELECT 'fista', * FROM ({basis_out('b')})""",
    ),
)
def central_descent(spark, sf):
    ista, _ = step_at_parity(spark, sf, "ista", aware=False)
    fista, _ = step_at_parity(spark, sf, "agd", aware=False, momentum="standard")
    a = matrix_rows(spark, ista, "i", "k").withColumn("method", F.lit("ista"))
    return a.unionByName(matrix_rows(spark, fista, "i", "k").withColumn("method", F.lit("fista")))


def local_sql(steps: int, lam: float) -> str:
    factor = "((t - 1) / (0.5 + sqrt(1 + 4 * t * t)))"
    return f"""lg AS (SELECT *, {TOP} AS top FROM gs),
  loc AS ( -- recursive
    SELECT 0 AS n, c, i, w1, w2, w1 AS y1, w2 AS y2, 1.0::DOUBLE AS t FROM parity, gs
    UNION ALL
    SELECT n + 1, c, i, n1, n2, n1 + (n1 - w1) * {factor}, n2 + (n2 - w2) * {factor}, 0.5 + sqrt(1 + 4 * t * t)
    FROM (SELECT r.*, {soft_sql('y1 - (y1 * g11 + y2 * g12 - p1) / top', f'{lam} / top')} AS n1,
        {soft_sql('y2 - (y1 * g12 + y2 * g22 - p2) / top', f'{lam} / top')} AS n2
      FROM loc r JOIN ps USING (c, i) JOIN (SELECT c, g11, g12, g22, top FROM lg) USING (c) WHERE n < {steps}))"""


@query(
    "f15_local_fista",
    with_(
        [*STATS, local_sql(20, 0.05)],
        f"SELECT c AS group_id, i, unnest([0, 1])::INT AS k, {r6('unnest([w1, w2])')} AS value FROM loc WHERE n = 20",
    ),
)
def local_fista(spark, sf):
    state, start = state_at_parity(spark, sf)
    found = np.stack(
        [
            B.fista(lambda w, g=g, p=state.cross[:, k, :]: w @ g - p, start, float(B.top_eigenvalue(g)), 0.05, 20)
            for k, g in enumerate(state.gram)
        ]
    )
    return matrix_rows(spark, found, "group_id", "i", "k")


@query(
    "f16_local_copies",
    with_(
        [*STATS, OMEGA, admm_sql(1, LAM)],
        f"""SELECT c AS group_id, i, unnest([0, 1])::INT AS k, {r6('unnest([v1, v2])')} AS copy,
          {r6('unnest([v1 - w1, v2 - w2])')} AS dual FROM v1 JOIN w1 USING (i)""",
    ),
)
def local_copies(spark, sf):
    w, copies = step_at_parity(spark, sf, "admm", aware=True, hyper=RHO, max_iter=1)
    copy = matrix_rows(spark, copies, "i", "group_id", "k").withColumnRenamed("value", "copy")
    dual = matrix_rows(spark, copies - w[:, None, :], "i", "group_id", "k").withColumnRenamed("value", "dual")
    return copy.join(dual, ["i", "group_id", "k"])


SSE = "sq AS (SELECT group_id AS c, var * (4 + 64 * n) - 1 AS sse FROM vars JOIN gs ON c = group_id)"


@query(
    "f17_objective",
    with_(
        [*STATS, OMEGA, SSE],
        f"""SELECT {r6(f'(SELECT 0.5 * sum(omega * sse) FROM sq JOIN om USING (c)) + {LAM} / 5 * sum(abs(w1) + abs(w2))')} AS objective,
          {r6('(SELECT 0.5 * sum(sqrt(sse)) / 64 FROM sq)')} AS fit_error FROM parity""",
    ),
)
def objective(spark, sf):
    state, basis = state_at_parity(spark, sf)
    omega = B.precision_weights(state.variances)
    row = (B.objective(state, basis, LAM, omega), B.fit_error(state, basis.shape[0]))
    found = small_table(spark, [row], "objective double, fit_error double")
    return found.select(*[rounded(c).alias(c) for c in found.columns])


def history_sql(steps: int) -> str:
    rows = [
        f"""SELECT {k} AS step,
      ((SELECT sum(q - 2 * mixed + inner_) FROM (
          SELECT c, q, (SELECT sum(w1 * p1 + w2 * p2) FROM ps JOIN w{k} USING (i) WHERE ps.c = gs.c) AS mixed,
            (SELECT sum(w1 * w1 * g11 + 2 * w1 * w2 * g12 + w2 * w2 * g22) FROM w{k}) AS inner_
          FROM gs JOIN qs USING (c))) + {LAM} * (SELECT sum(abs(w1) + abs(w2)) FROM w{k})) / 5 AS loss,
      (SELECT avg(d) FROM (SELECT sqrt(sum(pow(v1 - w1, 2) + pow(v2 - w2, 2))) AS d FROM v{k} JOIN w{k} USING (i) GROUP BY c)) AS violation,
      (SELECT sqrt({TOP}) FROM (SELECT sum(pow(a.w1 - b.w1, 2)) AS g11, sum((a.w1 - b.w1) * (a.w2 - b.w2)) AS g12,
          sum(pow(a.w2 - b.w2, 2)) AS g22 FROM w{k} a JOIN parity b USING (i))) AS distance"""
        for k in range(1, steps + 1)
    ]
    return f"""SELECT step, {r6('loss')} AS loss, {r6('violation')} AS violation, {r6('distance')} AS distance
      FROM ({' UNION ALL '.join(rows)})"""


HISTORY = with_(
    [*STATS, EQUAL, "qs AS (SELECT group_id AS c, sum(v * v) AS q FROM emb_cells GROUP BY group_id)", admm_sql(6, LAM)], history_sql(6)
)


@query("f18_history_wide", HISTORY)
def history_wide(spark, sf):
    """The same history with every step made in Spark: its violation is that of copies the driver never sees."""
    basis, df = fx.parity_means(spark, sf), fx.emb_h(spark, sf)
    state, _, _ = fit.known_weights_state(df)
    rows = []
    for k in range(1, 7):
        w, gap = wide_step_at_parity(spark, sf, "admm", aware=False, hyper=RHO, max_iter=k)
        loss = (B.squared_errors(state, w).sum() + LAM * np.abs(w).sum()) / len(state.groups)
        rows.append((k, float(loss), gap, B.distance(w, basis)))
    found = small_table(spark, rows, "step int, loss double, violation double, distance double")
    return found.select("step", *[rounded(c).alias(c) for c in found.columns[1:]])


@query("f18_history", HISTORY)
def history(spark, sf):
    basis = fx.parity_means(spark, sf)
    df = fx.emb_h(spark, sf)
    _, _, steps = fit.fit_basis(df, basis, solver="admm", lam=LAM, hyper=RHO, inner_iter=6, truth=basis)
    rows = [(k, loss, gap, far) for _, k, loss, gap, far in steps]
    found = small_table(spark, rows, "step int, loss double, violation double, distance double")
    return found.select("step", *[rounded(c).alias(c) for c in found.columns[1:]])


@query(
    "f19_noise_aware_switch",
    with_(
        [*STATS, OMEGA, TOTALS, "plain AS (SELECT c, 1.0::DOUBLE / count(*) OVER () AS omega FROM gs)",
         TOTALS.replace("tot AS", "tot0 AS").replace("pt AS", "pt0 AS").replace("om USING", "plain USING"),
         descent_sql("a", "parity", LAM, 35, "damped"),
         descent_sql("b", "parity", LAM, 35, "damped", "tot0", "pt0")],
        f"SELECT true AS aware, * FROM ({basis_out('a')}) UNION ALL SELECT false, * FROM ({basis_out('b')})",
    ),
)
def noise_aware_switch(spark, sf):
    parts = [
        matrix_rows(spark, step_at_parity(spark, sf, "agd", aware=aware)[0], "i", "k").withColumn("aware", F.lit(aware))
        for aware in (True, False)
    ]
    return parts[0].unionByName(parts[1])


@query(
    "f20_estimate_variance",
    with_(
        [
            EMB,
            EMB_H,
            GS,
            """lc AS (SELECT c, s2, g11, g12, g22, d / det AS l11, -b / det AS l12, a / det AS l22 FROM (
              SELECT *, a * d - b * b AS det FROM (SELECT c, g11, g12, g22, [1.0, 1.0, 1.0, 1.0, 4.0][c + 1] AS s2,
                1 + g11 / 100 AS a, g12 / 100 AS b, 1 + g22 / 100 AS d FROM gs)))""",
            """z AS (SELECT c, s2, l11 * (g11 * l11 + g12 * l12) + l12 * (g12 * l11 + g22 * l12) AS z1,
              l12 * (g11 * l12 + g12 * l22) + l22 * (g12 * l12 + g22 * l22) AS z2 FROM lc)""",
        ],
        f"""SELECT unnest([0, 1])::INT AS k, {r6('unnest([sum(z1 * s2), sum(z2 * s2)]) / pow(500.0, 2)', 9)} AS plain,
          {r6('unnest([sum(z1 / s2), sum(z2 / s2)]) / pow(sum(1 / s2), 2) / pow(100.0, 2)', 9)} AS aware FROM z""",
    ),
)
def estimate_variance(spark, sf):
    state, _, _ = fit.known_weights_state(fx.emb_h(spark, sf))
    plain, aware = B.estimate_variance(state.gram, np.array([1.0, 1.0, 1.0, 1.0, 2.0]), 100.0)
    rows = [(k, float(a), float(b)) for k, (a, b) in enumerate(zip(plain, aware))]
    found = small_table(spark, rows, "k int, plain double, aware double")
    return found.select("k", rounded("plain", 9).alias("plain"), rounded("aware", 9).alias("aware"))


# --- fits -------------------------------------------------------------------------------------


def rank1_sql(steps: int, lam: float) -> str:
    parts = [
        "sums AS (SELECT group_id AS c, i, count(*) AS n, sum(v) AS p FROM emb_cells GROUP BY ALL)",
        f"""r0 AS (SELECT i, v AS w FROM emb_cells JOIN (SELECT row_id FROM emb
          ORDER BY {fx.uniform_sql('row_id', '0', 3)}, row_id LIMIT 1) USING (row_id))""",
    ]
    for k in range(1, steps + 1):
        parts.append(
            f"""var{k} AS MATERIALIZED (SELECT group_id AS c, (sum(pow(v - w, 2)) + 1) / (4 + count(*)) AS var
    FROM emb_cells JOIN r{k - 1} USING (i) GROUP BY group_id),
  om{k} AS MATERIALIZED (SELECT c, (1 / var) / sum(1 / var) OVER () AS omega FROM var{k}),
  r{k} AS MATERIALIZED (SELECT i, {soft_sql('p', f'{lam} / groups')} / n AS w FROM (
    SELECT i, sum(omega * p) AS p, sum(omega * n) AS n, count(*) AS groups FROM sums JOIN om{k} USING (c) GROUP BY i))"""
        )
    return ",\n  ".join(parts)


@query(
    "f21_fit_rank1",
    with_(
        [EMB, EMB_CELLS, rank1_sql(3, LAM)],
        f"""SELECT 'basis' AS part, i AS id, {r6('w')} AS value FROM r3
          UNION ALL SELECT 'variance', c, {r6('var')} FROM var3""",
    ),
)
def fit_rank1(spark, sf):
    model = fy.factorize(fx.emb(spark, sf), 1, solver="agd", lam=LAM, noise_aware=True, max_iter=3, seed=3)
    w = matrix_rows(spark, model.basis[:, 0], "id").withColumn("part", F.lit("basis"))
    v = model.variance_table(spark).select(
        F.lit("variance").alias("part"), F.col("group_id").alias("id"), rounded("variance").alias("value")
    )
    return w.unionByName(v)


def fit2_sql(steps: int, lam: float, alpha: float) -> list[str]:
    """Outer steps at rank 2: bisect the weights, sum the statistics, descend."""
    parts = ["b0 AS (SELECT i, w1, w2 FROM parity)"]
    for k in range(1, steps + 1):
        parts += [
            simplex_sql(f"h{k}", f"b{k - 1}", alpha),
            f"""e{k} AS MATERIALIZED (SELECT c.row_id, c.group_id, c.i, c.v, h1, h2 FROM emb_cells c JOIN h{k} USING (row_id)),
  k{k} AS MATERIALIZED (SELECT c, (sse + 1) / (4 + cells) AS var, g11, g12, g22 FROM (
    SELECT group_id AS c, sum(pow(v - w1 * h1 - w2 * h2, 2)) AS sse, count(*) AS cells,
      sum(h1 * h1) / 64 AS g11, sum(h1 * h2) / 64 AS g12, sum(h2 * h2) / 64 AS g22
    FROM e{k} JOIN b{k - 1} USING (i) GROUP BY group_id)),
  o{k} AS MATERIALIZED (SELECT c, (1 / var) / sum(1 / var) OVER () AS omega, g11, g12, g22 FROM k{k}),
  t{k} AS MATERIALIZED (SELECT *, {TOP} AS top FROM (
    SELECT sum(omega * g11) AS g11, sum(omega * g12) AS g12, sum(omega * g22) AS g22, count(*) AS groups FROM o{k})),
  p{k} AS MATERIALIZED (SELECT i, sum(omega * v * h1) AS p1, sum(omega * v * h2) AS p2
    FROM e{k} JOIN o{k} ON c = group_id GROUP BY i)""",
            descent_sql(f"b{k}", f"b{k - 1}", lam, 35, "damped", f"t{k}", f"p{k}"),
        ]
    return parts


FIT2 = [EMB, EMB_CELLS, PARITY, *fit2_sql(2, LAM, 0.1)]


def fitted_rank2(spark, sf):
    return fy.factorize(
        fx.emb(spark, sf), 2, solver="agd", lam=LAM, alpha=0.1, noise_aware=True, max_iter=2,
        init=fx.parity_means(spark, sf),
    )


@query("f21_fit_rank2", with_(FIT2, basis_out("b2")))
def fit_rank2(spark, sf):
    return matrix_rows(spark, fitted_rank2(spark, sf).basis, "i", "k")


@query("f21_fit_rank2_blocks", with_(FIT2, basis_out("b2")))
def fit_rank2_blocks(spark, sf):
    """The same fit with rows and basis in blocks of 24 features."""
    start = wide_fit.basis_blocks(spark, fx.parity_means(spark, sf), 24)
    model = wide_fit.factorize_blocks(
        wide_fit.feature_blocks(fx.emb(spark, sf), 24), 2, solver="agd", lam=LAM, alpha=0.1, noise_aware=True, max_iter=2, init=start
    )
    cells = model.basis_rows().select(F.col("feature_id").alias("i"), F.posexplode("w").alias("k", "value"))
    return cells.withColumn("value", rounded("value"))


@query(
    "f21_labels_rank2",
    with_([*FIT2, simplex_sql("h", "b2", 0.1)], "SELECT row_id, CASE WHEN h1 >= h2 THEN 1 ELSE 2 END AS pred_label FROM h"),
)
def labels_rank2(spark, sf):
    return fitted_rank2(spark, sf).labels(fx.emb(spark, sf))


def nonnegative1_sql(steps: int, lam: float) -> str:
    parts = [
        f"""r0 AS (SELECT i, v AS w FROM os_cells JOIN (SELECT row_id FROM os
          ORDER BY {fx.uniform_sql('row_id', '0', 3)}, row_id LIMIT 1) USING (row_id))"""
    ]
    for k in range(1, steps + 1):
        parts.append(
            f"""h{k} AS MATERIALIZED (SELECT row_id, group_id AS c, greatest(sum(v * w), 0) / sum(w * w) AS h
    FROM os_cells JOIN r{k - 1} USING (i) GROUP BY ALL),
  s{k} AS MATERIALIZED (SELECT c, sum(h) / count(*) AS s, sum(h * h) AS g FROM h{k} GROUP BY c),
  p{k} AS MATERIALIZED (SELECT c, i, sum(v * h) AS p FROM os_cells JOIN h{k} USING (row_id) GROUP BY ALL),
  r{k} AS MATERIALIZED (SELECT i, {soft_sql('p', f'{lam} / 5')} / g AS w FROM (
    SELECT i, sum(p / s) / 5 AS p, sum(g / s / s) / 5 AS g FROM p{k} JOIN s{k} USING (c) GROUP BY i))"""
        )
    return ",\n  ".join(parts)


@query(
    "f21_nonnegative_rank1",
    with_([fx.ORDERS, fx.ORDER_CELLS, nonnegative1_sql(2, LAM)], f"SELECT i, {r6('w')} AS value FROM r2"),
)
def nonnegative_rank1(spark, sf):
    """Two outer steps with non-negative weights, rescaled by group, at rank 1."""
    model = fy.factorize(
        fx.order_sales(spark, sf), 1, solver="agd", lam=LAM, weights="nonnegative", max_iter=2, seed=3
    )
    return matrix_rows(spark, model.basis[:, 0], "i")


@query("f21_fit_labels")
def fit_labels(spark, sf):
    return flagship(spark, sf)


@query("f21_fit_labels_optimal", "SELECT vec_id, 1.0::DOUBLE AS total, true AS optimal, true AS first_largest FROM embeddings")
def fit_labels_optimal(spark, sf):
    """What the flagship's rows must satisfy: weights sum to one with equal slopes for the fitted basis, and the label is the first largest."""
    df = fx.emb(spark, sf)
    model = fy.factorize(df, 4, solver="agd", lam=0.1, alpha=0.1, max_iter=2, seed=1)
    q = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in model.basis.T @ model.basis])
    w = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in model.basis.T])
    dot = lambda a, b: A.row_sum(F.zip_with(a, b, lambda x, y: x * y))
    rows = model.weights(df, keep=("features",)).withColumn("slope", F.transform(q, lambda row, k: dot(row, F.col("h")) - dot(F.get(w, k), F.col("features")) - 0.1 / F.get("h", k)))
    spread = F.array_max("slope") - F.array_min("slope")
    label = F.array_position("h", F.array_max("h"))
    labels = model.labels(df).withColumnRenamed("row_id", "_id")
    joined = rows.join(labels, F.col("row_id") == F.col("_id"))
    return joined.select(
        F.col("row_id").alias("vec_id"), rounded(A.row_sum("h"), 4).alias("total"), (spread < 1e-4).alias("optimal"), (label == F.col("pred_label")).alias("first_largest")
    )


@query("f21_history_falls", "SELECT unnest([1, 2, 3, 4, 5])::INT AS step, true AS falls, 0::BIGINT AS unconverged")
def history_falls(spark, sf):
    """With equal weights of groups a fit never raises its penalised objective, and all rows' weights converge."""
    model = fy.factorize(fx.emb(spark, sf), 4, solver="agd", lam=0.1, noise_aware=False, max_iter=6, seed=1)
    values = [row[3] for row in model.history]
    rows = [(k, b <= a + 1e-9 * abs(a), model.history[k][7]) for k, (a, b) in enumerate(zip(values, values[1:]), start=1)]
    return small_table(spark, [(k, bool(f), int(n)) for k, f, n in rows], "step int, falls boolean, unconverged bigint")


@query("f21_fit_history")
def fit_history(spark, sf):
    model = fy.factorize(fx.emb(spark, sf), 4, solver="admm", lam=0.1, max_iter=4, seed=1)
    return model.history_table(spark).drop("seconds")


@query("f21_nonnegative_fit")
def nonnegative_fit(spark, sf):
    model = fy.factorize(
        fx.order_sales(spark, sf), 2, solver="cease", lam=0.1, hyper=1e-4, weights="nonnegative", max_iter=3, seed=1
    )
    return cells(model.weights(fx.order_sales(spark, sf)), "h", "group_id")


@query("f21_nonnegative_optimal", with_([fx.ORDERS], "SELECT row_id, true AS nonnegative, true AS optimal FROM os"))
def nonnegative_optimal(spark, sf):
    """The weights of a non-negative fit: none below zero, no slope below zero, and never both above."""
    df = fx.order_sales(spark, sf)
    model = fy.factorize(df, 2, solver="cease", lam=0.1, hyper=1e-4, weights="nonnegative", max_iter=3, seed=1)
    q = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in model.basis.T @ model.basis])
    w = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in model.basis.T])
    dot = lambda a, b: A.row_sum(F.zip_with(a, b, lambda x, y: x * y))
    rows = model.weights(df, keep=("features",)).withColumn("slope", F.transform(q, lambda row, k: dot(row, F.col("h")) - dot(F.get(w, k), F.col("features"))))
    size = 1 + F.array_max(F.transform("slope", F.abs))
    worst = F.array_max(F.zip_with("h", "slope", lambda h, s: F.greatest(-s, F.least(h, F.abs(s)))))
    return rows.select("row_id", (F.array_min("h") >= 0).alias("nonnegative"), (worst < 1e-6 * size).alias("optimal"))


@query(
    "f22_repeats",
    with_(
        [
            EMB,
            EMB_CELLS,
            f"""w AS (SELECT i, {soft_sql('p', str(LAM / 5))} / n AS w FROM (
              SELECT i, sum(v) / 5 AS p, count(*) / 5 AS n FROM emb_cells GROUP BY i))""",
        ],
        f"SELECT unnest([1, 2])::INT AS run, i, {r6('w')} AS value FROM w",
    ),
)
def repeats(spark, sf):
    models = fy.repeat_fit(fx.emb(spark, sf), 1, [3, 4], solver="agd", lam=LAM, max_iter=2)
    return matrix_rows(spark, np.stack([m.basis[:, 0] for m in models]), "run", "i").withColumn(
        "run", F.col("run") + 1
    )
