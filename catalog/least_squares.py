"""QR, least squares, non-negative least squares and separable factorisation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

import facetry as fy
from facetry.functions import arrays as A
from facetry.operators import extreme_columns as X
from facetry.operators import group_stats as G
from facetry.operators import krylov as K
from facetry.operators import least_squares as L
from facetry.operators import tsqr as Q
from facetry.operators import wide_qr as WQ
from facetry.operators.blocks import small_table
from facetry.operators.weights import nonnegative_least_squares
from facetry.plans import separable_nmf as S
from facetry.session import write_scratch

from . import fixtures as fx
from .fixtures import EMB, EMB_CELLS, ORDERS, ORDER_CELLS, PARITY, USERS, USER_CELLS, cells, matrix_rows, r6, rounded, with_
from .registry import query

EMB_GRAM = with_(
    [EMB, EMB_CELLS],
    f"SELECT a.i, b.i AS j, {r6('sum(a.v * b.v)')} AS value FROM emb_cells a JOIN emb_cells b ON a.row_id = b.row_id GROUP BY ALL",
)
ORDER_GRAM = "og AS (SELECT " + ", ".join(f"sum(x{i} * x{j}) AS g{i}{j}" for i in range(4) for j in range(i, 4)) + " FROM os)"


def factor_sql(width: int) -> str:
    """R of a QR as the triangular factor of X'X, row by row: a chain of CTEs, the last one ``r``."""
    parts = [f"r_0 AS (SELECT * FROM {'og'})"]
    for i in range(width):
        own = " - ".join([f"g{i}{i}", *(f"r{k}{i} * r{k}{i}" for k in range(i))])
        parts.append(f"d_{i} AS (SELECT *, sqrt({own}) AS r{i}{i} FROM r_{i})")
        row = [f"({' - '.join([f'g{i}{j}', *(f'r{k}{i} * r{k}{j}' for k in range(i))])}) / r{i}{i} AS r{i}{j}" for j in range(i + 1, width)]
        parts.append(f"r_{i + 1} AS (SELECT {', '.join(['*', *row])} FROM d_{i})")
    return ",\n  ".join([*parts, f"r AS (SELECT * FROM r_{width})"])


def thin_q_sql(width: int) -> str:
    """Rows of Q by back substitution: CTEs q_1, q_2, ... over the orders."""
    parts = ["q_0 AS (SELECT * FROM os, r)"]
    for j in range(width):
        left = " - ".join([f"x{j}", *(f"q{k} * r{k}{j}" for k in range(j))])
        parts.append(f"q_{j + 1} AS (SELECT *, ({left}) / r{j}{j} AS q{j} FROM q_{j})")
    return ",\n  ".join(parts)


@query("n1_tsqr_gram", EMB_GRAM)
def tsqr_gram(spark, sf):
    """R'R of the tall-skinny QR, which must be X'X."""
    r = Q.r_matrix(fx.emb(spark, sf))
    return matrix_rows(spark, r.T @ r, "i", "j")


@query(
    "n1_tsqr_factor",
    with_(
        [ORDERS, ORDER_GRAM, factor_sql(4)],
        f"""SELECT unnest({[i for i in range(4) for _ in range(4)]})::INT AS i, unnest({list(range(4)) * 4})::INT AS j,
          {r6(f"unnest([{', '.join(f'r{i}{j}' if i <= j else '0.0' for i in range(4) for j in range(4))}])")} AS value FROM r""",
    ),
)
def tsqr_factor(spark, sf):
    long = Q.tsqr_r(fx.order_sales(spark, sf)).select("i", F.posexplode("features").alias("j", "value"))
    return long.withColumn("value", rounded("value"))


@query("n2_builtin_r", EMB_GRAM)
def builtin_r(spark, sf):
    r = Q.mllib_r(fx.emb(spark, sf))
    return matrix_rows(spark, r.T @ r, "i", "j")


@query(
    "n3_thin_q",
    with_(
        [ORDERS, ORDER_GRAM, factor_sql(4), thin_q_sql(4)],
        f"SELECT row_id, unnest([0, 1, 2, 3])::INT AS i, {r6('unnest([q0, q1, q2, q3])', 9)} AS value FROM q_4",
    ),
)
def thin_q(spark, sf):
    """The aggregated orders are written once and read twice: for R, and for Q."""
    sales = write_scratch(fx.order_sales(spark, sf).select("row_id", "features"), "sales")
    q = Q.thin_q(sales, Q.r_matrix(sales))
    return q.select("row_id", F.posexplode("features").alias("i", "value")).withColumn("value", rounded("value", 9))


@query(
    "n4_normalized_columns",
    with_(
        [ORDERS, ORDER_CELLS],
        f"SELECT row_id, i, {r6('v / sum(abs(v)) OVER (PARTITION BY i)', 9)} AS value FROM os_cells",
    ),
)
def normalized_columns(spark, sf):
    df = fx.order_sales(spark, sf)
    scaled = S.normalize_columns(df, S.column_norms(df, 4))
    return scaled.select("row_id", F.posexplode("features").alias("i", "value")).withColumn("value", rounded("value", 9))


def nnls2_sql(b1: str, b2: str, q11: str, q12: str, q22: str) -> str:
    """The two-variable non-negative least squares solution as a list."""
    det = f"({q11} * {q22} - {q12} * {q12})"
    one, two = f"({q22} * {b1} - {q12} * {b2})", f"({q11} * {b2} - {q12} * {b1})"
    return f"""(CASE WHEN {one} >= 0 AND {two} >= 0 THEN [{one} / {det}, {two} / {det}]
      WHEN pow(greatest({b1}, 0), 2) / {q11} >= pow(greatest({b2}, 0), 2) / {q22} THEN [greatest({b1}, 0) / {q11}, 0.0]
      ELSE [0.0, greatest({b2}, 0) / {q22}] END)"""


@query(
    "n5_nonnegative_pairs",
    with_(
        [
            EMB,
            EMB_CELLS,
            PARITY,
            "g AS (SELECT sum(w1 * w1) AS a, sum(w1 * w2) AS b, sum(w2 * w2) AS d FROM parity)",
            "rhs AS (SELECT row_id, sum(v * w1) AS p1, sum(v * w2) AS p2 FROM emb_cells JOIN parity USING (i) GROUP BY row_id)",
        ],
        f"SELECT row_id, unnest([0, 1])::INT AS i, {r6('unnest(' + nnls2_sql('p1', 'p2', 'a', 'b', 'd') + ')', 5)} AS value FROM rhs, g",
    ),
)
def nonnegative_pairs(spark, sf):
    basis = fx.parity_means(spark, sf)
    rhs = fy.map_blocks(fx.emb(spark, sf).select("row_id", "features"), lambda x: x @ basis).withColumnRenamed("features", "atb")
    h = nonnegative_least_squares(rhs, basis.T @ basis)
    return h.select("row_id", F.posexplode("h").alias("i", "value")).withColumn("value", rounded("value", 5))


@query("n5_nonnegative_optimality", with_([EMB], "SELECT row_id, true AS nonnegative, true AS optimal FROM emb"))
def nonnegative_optimality(spark, sf):
    """Eight variables: weights and slopes are non-negative and never both positive."""
    df = fx.emb(spark, sf)
    basis = fy.initial_basis(df, 8, "random_rows", seed=3)
    ata = basis.T @ basis
    rhs = fy.map_blocks(df.select("row_id", "features"), lambda x: x @ basis).withColumnRenamed("features", "atb")
    q = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in ata])
    solved = nonnegative_least_squares(rhs, ata).join(rhs, "row_id")
    slope = F.transform(q, lambda qk, k: A.row_sum(F.zip_with(qk, F.col("h"), lambda a, b: a * b)) - F.get("atb", k))
    worst = F.zip_with("h", "slope", lambda h, s: F.greatest(-s, F.abs(h * s)))
    return solved.withColumn("slope", slope).select(
        "row_id", (F.array_min("h") >= 0).alias("nonnegative"), (F.array_max(worst) < 1e-8).alias("optimal")
    )


def picks_sql(normalized: bool) -> str:
    """C and the first two extreme columns s1, s2 of the user events."""
    value = "v / sum(v) OVER (PARTITION BY i)" if normalized else "v"
    return f"""nrm AS (SELECT i, sum(v) AS norm FROM ue_cells GROUP BY i),
  vc AS (SELECT row_id, i, {value} AS v FROM ue_cells),
  cm AS (SELECT a.i, b.i AS j, sum(a.v * b.v) AS c FROM vc a JOIN vc b ON a.row_id = b.row_id GROUP BY ALL),
  dg AS (SELECT i AS j, c AS own FROM cm WHERE i = j),
  sc1 AS (SELECT j, sqrt(sum(pow(greatest(c, 0), 2))) / sqrt(max(own)) AS score FROM cm JOIN dg USING (j) GROUP BY j),
  s1 AS (SELECT j AS s, score FROM sc1 ORDER BY score DESC, j LIMIT 1),
  h1 AS (SELECT i, greatest(c, 0) / (SELECT own FROM dg, s1 WHERE j = s) AS h, c AS cs FROM cm, s1 WHERE j = s),
  sc2 AS (SELECT cm.j, sqrt(sum(pow(greatest(cm.c - h1.h * o.cs, 0), 2))) / sqrt(max(own)) AS score
    FROM cm JOIN h1 ON h1.i = cm.i JOIN h1 o ON o.i = cm.j JOIN dg ON dg.j = cm.j WHERE cm.j <> (SELECT s FROM s1) GROUP BY cm.j),
  s2 AS (SELECT j AS s, score FROM sc2 ORDER BY score DESC, j DESC LIMIT 1)"""


CHOSEN = [USERS, USER_CELLS, picks_sql(False)]


@query(
    "n6_extreme_columns",
    with_(CHOSEN, f"SELECT 0 AS pick, s AS column_index, {r6('score')} AS score FROM s1 UNION ALL SELECT 1, s, {r6('score')} FROM s2"),
)
def extreme_columns(spark, sf):
    c = G.gram_matrix(fx.user_events(spark, sf))
    columns, _ = X.choose_columns(c, 2)
    none = X.column_scores(c, np.diagonal(c), [], np.zeros((len(c), 0)))
    one = X.column_scores(c, np.diagonal(c), columns[:1], X.column_weights(c, columns[:1]).T)
    rows = [(0, columns[0], float(none[columns[0]])), (1, columns[1], float(one[columns[1]]))]
    found = small_table(spark, rows, "pick int, column_index int, score double")
    return found.withColumn("score", rounded("score"))


@query(
    "n6_extreme_columns_wide",
    with_(CHOSEN, "SELECT 0 AS pick, s AS column_index FROM s1 UNION ALL SELECT 1, s FROM s2"),
)
def extreme_columns_wide(spark, sf):
    """The same picks with C kept as a table, made from tiles of two columns."""
    rows = X.gram_rows(fx.user_events(spark, sf), tile=2).persist()
    try:
        columns, _ = X.choose_columns_wide(rows, 5, 2)
    finally:
        rows.unpersist()
    return small_table(spark, list(enumerate(columns)), "pick int, column_index int")


@query(
    "n7_nmf_loadings",
    with_(
        CHOSEN,
        f"""SELECT row_id, 0 AS i, {r6('v')} AS value FROM ue_cells JOIN s1 ON i = s
        UNION ALL SELECT row_id, 1, {r6('v')} FROM ue_cells JOIN s2 ON i = s""",
    ),
)
def nmf_loadings(spark, sf):
    df = fx.user_events(spark, sf)
    return cells(fy.separable_nmf(df, 2).loadings(df), "h")


PAIR_WEIGHTS = f"""pw AS (
  SELECT b1.i, {nnls2_sql('b1.c', 'b2.c', 'q.a', 'q.b', 'q.d')} AS h
  FROM (SELECT i, c FROM cm, s1 WHERE j = s) b1 JOIN (SELECT i, c FROM cm, s2 WHERE j = s) b2 USING (i),
    (SELECT max(CASE WHEN i = s1.s AND j = s1.s THEN c END) AS a, max(CASE WHEN i = s1.s AND j = s2.s THEN c END) AS b,
      max(CASE WHEN i = s2.s AND j = s2.s THEN c END) AS d FROM cm, s1, s2) q)"""


@query(
    "n8_column_weights",
    with_(
        [*CHOSEN, PAIR_WEIGHTS],
        f"SELECT unnest([0, 1])::INT AS k, i, {r6('unnest([h[1], h[2]])')} AS value FROM pw",
    ),
)
def column_weights(spark, sf):
    c = G.gram_matrix(fx.user_events(spark, sf))
    columns, _ = X.choose_columns(c, 2)
    return matrix_rows(spark, X.column_weights(c, columns), "k", "i")


@query(
    "n7_nmf_weights",
    with_(
        [*CHOSEN, PAIR_WEIGHTS],
        f"SELECT unnest([0, 1])::INT AS k, i, {r6('unnest([h[1], h[2]]) * norm')} AS value FROM pw JOIN nrm USING (i)",
    ),
)
def nmf_weights(spark, sf):
    return matrix_rows(spark, fy.separable_nmf(fx.user_events(spark, sf), 2, via="qr").h, "k", "i")


@query(
    "n9_normalized_nmf",
    with_(
        [USERS, USER_CELLS, picks_sql(True)],
        f"""SELECT row_id, 0 AS i, {r6('v', 9)} AS value FROM vc JOIN s1 ON i = s
        UNION ALL SELECT row_id, 1, {r6('v', 9)} FROM vc JOIN s2 ON i = s""",
    ),
)
def normalized_nmf(spark, sf):
    df = fx.user_events(spark, sf)
    loadings = fy.separable_nmf(df, 2, normalize=True).loadings(df)
    return loadings.select("row_id", F.posexplode("h").alias("i", "value")).withColumn("value", rounded("value", 9))


MOMENTS = """mo AS (SELECT sum(x0 * x0) AS a, sum(x0 * x1) AS b, sum(x1 * x1) AS d, sum(x0 * x2) AS u0, sum(x1 * x2) AS u1,
  sum(x0 * x3) AS t0, sum(x1 * x3) AS t1 FROM os)"""


def ridge_sql(lambdas: str) -> str:
    det = "((a + l) * (d + l) - b * b)"
    return with_(
        [ORDERS, MOMENTS],
        f"""SELECT l AS lambda, unnest([0, 1, 0, 1])::INT AS feature_id, unnest(['discount', 'discount', 'tax', 'tax']) AS target,
      {r6(f'''unnest([((d + l) * u0 - b * u1) / {det}, ((a + l) * u1 - b * u0) / {det},
        ((d + l) * t0 - b * t1) / {det}, ((a + l) * t1 - b * t0) / {det}])''')} AS coefficient
      FROM mo, (SELECT unnest({lambdas})::DOUBLE AS l)""",
    )


TARGETS = ["discount", "tax"]


@query("n10_ridge", ridge_sql("[0.0, 0.1, 10.0]"))
def ridge(spark, sf):
    found = L.coefficients(spark, L.ridge(fx.order_pair(spark, sf), TARGETS, [0.0, 0.1, 10.0]), TARGETS)
    return found.withColumn("coefficient", rounded("coefficient"))


@query("n11_qr_solve", ridge_sql("[0.0]"))
def qr_solve(spark, sf):
    found = L.coefficients(spark, {0.0: Q.least_squares_qr(fx.order_pair(spark, sf), TARGETS)}, TARGETS)
    return found.withColumn("coefficient", rounded("coefficient"))


@query("n10_ridge_passes", ridge_sql("[0.0, 0.1, 10.0]"))
def ridge_passes(spark, sf):
    """The same solutions from passes X'(XP), for all lambdas at once and without the Gram matrix."""
    found = L.coefficients(spark, K.ridge_wide(fx.order_pair(spark, sf), TARGETS, [0.0, 0.1, 10.0], tol=1e-14), TARGETS)
    return found.withColumn("coefficient", rounded("coefficient"))


@query(
    "n1_tsqr_factor_panels",
    with_(
        [ORDERS, ORDER_GRAM, factor_sql(4)],
        f"""SELECT unnest({[i for i in range(4) for _ in range(4)]})::INT AS i, unnest({list(range(4)) * 4})::INT AS j,
          {r6(f"unnest([{', '.join(f'r{i}{j}' if i <= j else '0.0' for i in range(4) for j in range(4))}])")} AS value FROM r""",
    ),
)
def tsqr_factor_panels(spark, sf):
    """R in panels of two columns."""
    found = WQ.wide_qr(fx.order_sales(spark, sf).select("features"), 4, panel=2).r_rows()
    return found.select("i", F.posexplode("features").alias("j", "value")).withColumn("value", rounded("value"))


@query(
    "n3_thin_q_panels",
    with_(
        [ORDERS, ORDER_GRAM, factor_sql(4), thin_q_sql(4)],
        f"SELECT row_id, unnest([0, 1, 2, 3])::INT AS i, {r6('unnest([q0, q1, q2, q3])', 9)} AS value FROM q_4",
    ),
)
def thin_q_panels(spark, sf):
    """Q in panels of two columns."""
    q = WQ.wide_qr(fx.order_sales(spark, sf).select("row_id", "features"), 4, panel=2).q
    return q.select("row_id", F.posexplode("features").alias("i", "value")).withColumn("value", rounded("value", 9))


@query("n11_qr_solve_panels", ridge_sql("[0.0]"))
def qr_solve_panels(spark, sf):
    pair = fx.order_pair(spark, sf)
    solved = WQ.least_squares_wide(pair, TARGETS, len(pair.first().features), panel=2)
    return L.coefficients(spark, {0.0: solved}, TARGETS).withColumn("coefficient", rounded("coefficient"))
