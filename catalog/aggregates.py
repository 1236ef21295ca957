"""Reductions, norms, Gram matrices, spectra and key joins."""

from __future__ import annotations

from pyspark.sql import functions as F

import facetry as fy
from facetry.functions import arrays as A
from facetry.operators import basis as B
from facetry.operators import group_stats as G
from facetry.operators import krylov as K
from facetry.operators import matrix as M
from facetry.operators import scoring
from facetry.operators.blocks import map_blocks, small_table
from facetry.plans.factorize import known_weights_state

from . import fixtures as fx
from .fixtures import EMB, EMB_CELLS, EMB_H, ORDER_CELLS, ORDERS, PARITY, cells, r6, rounded, with_
from .registry import query

HOW = ["sum", "prod", "min", "max"]
HOW_SQL = "unnest(['sum', 'prod', 'min', 'max']) AS how"


def unpivoted(df, *keys):
    """A column per reducer turned into rows ``how, value``."""
    return df.unpivot(list(keys), HOW, "how", "value").withColumn("value", rounded("value"))


def near_one(df):
    """1 + x / 1000, so that products over a whole table stay finite."""
    return df.withColumn("features", A.map_cells("features", lambda x: 1 + x / 1000))


@query("a1_dims", "SELECT count(*) AS n_rows, max(len(embedding))::INT AS n_cols, (count(*) * max(len(embedding)))::BIGINT AS n_cells FROM embeddings")
def dims(spark, sf):
    return M.dims(fx.emb(spark, sf))


@query("a2_fold_cells", with_([EMB, EMB_CELLS], f"SELECT {r6('sum(pow(abs(v), 3))')} AS value FROM emb_cells"))
def fold_cells(spark, sf):
    folded = M.fold_cells(fx.emb(spark, sf), 0.0, lambda acc, x: acc + F.pow(F.abs(x), F.lit(3.0)))
    return folded.withColumn("value", rounded("value"))


@query(
    "a3_reduce_cells",
    with_(
        [EMB, EMB_CELLS],
        f"SELECT {HOW_SQL}, {r6('unnest([sum(1 + v / 1000), product(1 + v / 1000), min(1 + v / 1000), max(1 + v / 1000)])')} AS value FROM emb_cells",
    ),
)
def reduce_cells(spark, sf):
    return unpivoted(M.reduce_cells(near_one(fx.emb(spark, sf)), *HOW))


@query(
    "a4_reduce_rows",
    with_(
        [ORDERS, ORDER_CELLS],
        f"SELECT row_id, {HOW_SQL}, {r6('unnest([sum(v), product(v), min(v), max(v)])')} AS value FROM os_cells GROUP BY row_id",
    ),
)
def reduce_rows(spark, sf):
    return unpivoted(M.reduce_rows(fx.order_sales(spark, sf), *HOW), "row_id")


@query(
    "a5_reduce_columns",
    with_(
        [EMB, EMB_CELLS],
        f"SELECT i AS feature_id, {HOW_SQL}, {r6('unnest([sum(1 + v / 1000), product(1 + v / 1000), min(1 + v / 1000), max(1 + v / 1000)])')} AS value FROM emb_cells GROUP BY i",
    ),
)
def reduce_columns(spark, sf):
    return unpivoted(M.reduce_columns(near_one(fx.emb(spark, sf)), *HOW), "feature_id")


@query(
    "a6_norms",
    with_(
        [ORDERS, ORDER_CELLS],
        f"SELECT {r6('sum(v * v)', 4)} AS squared, {r6('sqrt(sum(v * v))')} AS frobenius, {r6('sqrt(sum(v * v)) / sqrt(count(*))')} AS mean_scaled FROM os_cells",
    ),
)
def norms(spark, sf):
    n = M.norms(fx.order_sales(spark, sf))
    return n.select(
        rounded("squared", 4).alias("squared"),
        rounded("frobenius").alias("frobenius"),
        rounded("mean_scaled").alias("mean_scaled"),
    )


@query(
    "a7_sparseness",
    with_(
        [EMB, EMB_CELLS],
        f"SELECT {r6('(sqrt(count(*)) - sum(abs(v)) / sqrt(sum(v * v))) / (sqrt(count(*)) - 1)')} AS sparseness FROM emb_cells",
    ),
)
def sparseness(spark, sf):
    return M.sparseness(fx.emb(spark, sf)).select(rounded("sparseness").alias("sparseness"))


@query(
    "a8_group_gram",
    with_(
        [EMB, EMB_CELLS],
        f"""SELECT a.group_id, a.i, b.i AS j, {r6('sum(a.v * b.v)')} AS value
          FROM emb_cells a JOIN emb_cells b ON a.row_id = b.row_id GROUP BY ALL""",
    ),
)
def group_gram(spark, sf):
    return G.group_gram(fx.emb(spark, sf)).withColumn("value", rounded("value"))


CROSS = """crossed AS (
  SELECT group_id, i, j, sum(v * h) AS value FROM (
    SELECT group_id, unnest(range(len(x)))::INT AS i, unnest(x) AS v, j, h
    FROM (SELECT group_id, x, unnest([0, 1])::INT AS j, unnest([h1, h2]) AS h FROM emb_h)) GROUP BY ALL)"""


@query(
    "a8_cross_gram",
    with_(
        [EMB, EMB_H, CROSS],
        f"""SELECT 'P' AS part, group_id, i, j, {r6('value')} AS value FROM crossed
        UNION ALL SELECT 'G', group_id, unnest([0, 0, 1, 1])::INT, unnest([0, 1, 0, 1])::INT,
          {r6('unnest([sum(h1 * h1), sum(h1 * h2), sum(h1 * h2), sum(h2 * h2)])')} FROM emb_h GROUP BY group_id""",
    ),
)
def cross_gram(spark, sf):
    stats = G.weighted_statistics(fx.emb_h(spark, sf)).filter(F.col("kind") >= G.GRAM)
    part = F.when(F.col("kind") == G.GRAM, "G").otherwise("P")
    return stats.select(part.alias("part"), "group_id", "i", "j", rounded("value").alias("value"))


ROOT = "sqrt((a - d) * (a - d) + 4 * b * b)"


def mean_order_gram(spark, sf):
    """X'X / n of all four features from one pass: a fifth feature of ones carries the count."""
    sales = fx.order_sales(spark, sf).withColumn("features", F.concat("features", F.array(F.lit(1.0))))
    gram = G.gram_matrix(sales)
    return gram[:4, :4] / gram[4, 4]


def power_sql(width: int, steps: int) -> str:
    """The largest eigenvalue of X'X / n by power iteration. -- recursive"""
    cell = lambda i, j: f"g{min(i, j)}{max(i, j)}"
    rows = [" + ".join(f"{cell(i, j)} * v{j}" for j in range(width)) for i in range(width)]
    gram = ", ".join(f"sum(x{i} * x{j}) / count(*) AS g{i}{j}" for i in range(width) for j in range(i, width))
    size = "sqrt(" + " + ".join(f"y{i} * y{i}" for i in range(width)) + ")"
    return f"""g AS (SELECT {gram} FROM os),
  it AS ( -- recursive
    SELECT 0 AS k, {', '.join(f'1.0::DOUBLE AS v{i}' for i in range(width))}, 0.0::DOUBLE AS top
    UNION ALL
    SELECT k + 1, {', '.join(f'y{i} / {size}' for i in range(width))}, {size}
    FROM (SELECT k, {', '.join(f'{r} AS y{i}' for i, r in enumerate(rows))} FROM it, g WHERE k < {steps}))"""


@query("a9_top_eigenvalue", with_([ORDERS, power_sql(4, 200)], f"SELECT {r6('top')} AS value FROM it WHERE k = 200"))
def top_eigenvalue(spark, sf):
    value = float(B.top_eigenvalue(mean_order_gram(spark, sf)))
    return small_table(spark, [(value,)], "value double").select(rounded("value").alias("value"))


SPECTRUM = with_(
    [EMB, EMB_H, "g AS (SELECT sum(h1 * h1) AS a, sum(h1 * h2) AS b, sum(h2 * h2) AS d FROM emb_h)"],
    f"""SELECT {r6(f'(a + d - {ROOT}) / 2')} AS smallest, {r6(f'(a + d + {ROOT}) / 2')} AS largest,
      {r6(f'(a + d + {ROOT}) / (a + d - {ROOT})')} AS condition FROM g""",
)


@query("a10_weight_spectrum_passes", SPECTRUM)
def weight_spectrum_passes(spark, sf):
    """The same from passes over the weights, without their Gram matrix."""
    found = small_table(spark, [K.extreme_eigenvalues(fx.emb_h(spark, sf), column="h")], "smallest double, largest double, condition double")
    return found.select(*[rounded(c).alias(c) for c in found.columns])


@query("a10_weight_spectrum", SPECTRUM)
def weight_spectrum(spark, sf):
    state, _, _ = known_weights_state(fx.emb_h(spark, sf))
    found = small_table(spark, [B.weight_spectrum(state.gram)], "smallest double, largest double, condition double")
    return found.select(*[rounded(c).alias(c) for c in found.columns])


@query(
    "a11_column_l1_norms",
    with_([EMB, EMB_CELLS], f"SELECT i AS feature_id, {r6('sum(abs(v))')} AS value FROM emb_cells GROUP BY i"),
)
def column_l1_norms(spark, sf):
    return M.column_l1_norms(fx.emb(spark, sf)).select("feature_id", rounded("norm").alias("value"))


@query("a12_label_counts", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def label_counts(spark, sf):
    return M.label_counts(fx.emb(spark, sf))


VARIANCES = """vars AS (
  SELECT group_id, (sum(d * d) + 1) / (4 + 64 * count(DISTINCT row_id)) AS var
  FROM (SELECT e.row_id, e.group_id, p.i, e.x[p.i + 1] - p.w1 * h1 - p.w2 * h2 AS d FROM emb_h e, parity p) GROUP BY group_id)"""
VARIANCE_CTES = [EMB, EMB_CELLS, EMB_H, PARITY, VARIANCES]


def state_at_parity(spark, sf):
    """Statistics of the embeddings at the parity basis, with rank-2 weights given."""
    basis = fx.parity_means(spark, sf)
    df = fx.emb_h(spark, sf)
    return G.read_state(G.weighted_statistics(df, basis), G.group_ids(df), basis.shape[0], 2), basis


@query(
    "a13_precision_weights",
    with_(VARIANCE_CTES, f"SELECT group_id, {r6('(1 / var) / sum(1 / var) OVER ()')} AS omega FROM vars"),
)
def precision_weights(spark, sf):
    state, _ = state_at_parity(spark, sf)
    rows = list(zip(state.groups.tolist(), B.precision_weights(state.variances).tolist()))
    return small_table(spark, rows, "group_id int, omega double").withColumn("omega", rounded("omega"))


@query(
    "a14_argmax",
    with_(
        [EMB],
        "SELECT row_id, list_position(x, list_max(x))::INT AS label, list_position(x, list_max(x))::INT - 1 AS column_index FROM emb",
    ),
)
def argmax(spark, sf):
    df = fx.emb(spark, sf)
    return df.select("row_id", A.argmax("features").alias("label"), A.argmax("features", 0).alias("column_index"))


# --- joins ------------------------------------------------------------------------------------


@query(
    "j1_paired_tables",
    with_([EMB, EMB_CELLS], f"SELECT row_id, i, {r6('v * abs(v)')} AS value FROM emb_cells"),
)
def paired_tables(spark, sf):
    a = fx.emb(spark, sf)
    return cells(M.combine(a, a.withColumn("features", A.map_cells("features", F.abs)), "*"))


@query(
    "j2_label_pairs",
    with_([EMB], "SELECT row_id, label AS true_label, ((list_position(x, list_max(x)) - 1) % 10)::INT AS pred_label FROM emb"),
)
def label_pairs(spark, sf):
    df = fx.emb(spark, sf)
    truth = df.select("row_id", F.col("label").alias("true_label"))
    guess = df.select("row_id", (A.argmax("features", 0) % 10).cast("int").alias("pred_label"))
    return scoring.label_pairs(truth, guess)


@query(
    "j3_shared_basis",
    with_(
        [EMB, EMB_CELLS, PARITY],
        f"""SELECT row_id, unnest([0, 1])::INT AS i, {r6('unnest([sum(v * w1), sum(v * w2)])')} AS value
          FROM emb_cells JOIN parity USING (i) GROUP BY row_id""",
    ),
)
def shared_basis(spark, sf):
    basis = fx.parity_means(spark, sf)
    return cells(map_blocks(fx.emb(spark, sf), lambda x: x @ basis))


@query("j4_row_numbers", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id FROM orders")
def row_numbers(spark, sf):
    """The orders numbered by key, without a window over the table."""
    return fy.number_rows(fx.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query(
    "p2_row_slice_by_number",
    """SELECT o_orderkey, row_id FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id, count(*) OVER () AS n FROM orders)
      WHERE row_id >= n // 4 AND row_id < n // 2""",
)
def row_slice_by_number(spark, sf):
    """The second quarter of the orders by place."""
    orders = fx.table(spark, sf, "orders").select("o_orderkey")
    n = orders.count()
    return M.row_slice(fy.number_rows(orders, "o_orderkey"), n // 4, n // 2)
