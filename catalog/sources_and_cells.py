"""Sources, noise, slices, samples and cell functions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

import facetry as fy
from facetry.functions import arrays as A
from facetry.operators import matrix as M
from facetry.operators.blocks import map_blocks, to_numpy
from facetry.session import scratch_path, write_scratch
from facetry.sources import delimited, noise, planted, tables

from . import fixtures as fx
from .fixtures import EMB, EMB_CELLS, ORDER_CELLS, ORDERS, PARITY, cells, r6, rounded, soft_sql, with_
from .registry import query

EMB_LONG = with_([EMB, EMB_CELLS], f"SELECT row_id, i, {r6('v')} AS value FROM emb_cells")


def emb_map(expression: str, extra: str = "") -> str:
    return with_([EMB, EMB_CELLS], f"SELECT row_id, i, {r6(expression)} AS value FROM emb_cells {extra}")


# --- sources ----------------------------------------------------------------------------------


@query(
    "s1_labelled_lines",
    with_([EMB, EMB_CELLS], f"SELECT row_id, label, i, {r6('v')} AS value FROM emb_cells"),
)
def labelled_lines(spark, sf):
    line = F.concat_ws(",", F.col("label").cast("double").cast("string"), F.transform("features", lambda x: x.cast("string")))
    lines = fx.emb(spark, sf).select("row_id", line.alias("value"))
    return cells(delimited.parse_lines(lines, ",", has_label=True), "features", "label")


@query(
    "s1_unlabelled_lines",
    with_([ORDERS, ORDER_CELLS], f"SELECT row_id, -1 AS label, i, {r6('v')} AS value FROM os_cells"),
)
def unlabelled_lines(spark, sf):
    line = F.concat(F.concat_ws(" ; ", F.transform("features", lambda x: x.cast("string"))), F.lit(" ;;"))
    lines = fx.order_sales(spark, sf).select("row_id", line.alias("value"))
    return cells(delimited.parse_lines(lines, r"\s*;\s*"), "features", "label")


@query(
    "s1_read_text",
    with_(
        [EMB, EMB_CELLS],
        f"SELECT n - 1 AS row_id, i, {r6('v')} AS value FROM emb_cells JOIN (SELECT row_id, row_number() OVER (ORDER BY row_id) AS n FROM emb) USING (row_id)",
    ),
)
def read_text(spark, sf):
    """Embeddings written as text files in order of key, and read back: lines are numbered by place."""
    path = scratch_path(spark, "text")
    line = F.concat_ws(",", F.transform("features", lambda x: x.cast("string")))
    fx.emb(spark, sf).orderBy("row_id").select(line.alias("value")).write.text(path)
    return cells(fy.read_delimited(spark, path))


@query(
    "s2_from_columns",
    f"""SELECT c_custkey AS row_id, unnest([0, 1])::INT AS i,
      {r6('unnest([c_acctbal, c_nationkey::DOUBLE])')} AS value FROM customer""",
)
def from_columns(spark, sf):
    return cells(tables.from_columns(fx.table(spark, sf, "customer"), ["c_acctbal", "c_nationkey"], "c_custkey"))


@query("s2_from_array", EMB_LONG)
def from_array(spark, sf):
    return cells(tables.check_width(fx.emb(spark, sf), 64))


@query("s3_groups", with_([ORDERS], "SELECT group_id, count(*) AS n FROM os GROUP BY group_id"))
def groups(spark, sf):
    return M.label_counts(fx.order_sales(spark, sf), "group_id")


@query("s4_dense_rows", with_([fx.USERS, fx.USER_CELLS], f"SELECT row_id, i, {r6('v')} AS value FROM ue_cells"))
def dense_rows(spark, sf):
    return cells(fx.user_events(spark, sf))


@query(
    "s5_random_matrix",
    f"""SELECT o_orderkey AS row_id, i::INT AS i, {r6(fx.uniform_sql('o_orderkey', 'i', 11))} AS value
      FROM (SELECT o_orderkey, unnest([0, 1, 2]) AS i FROM orders)""",
)
def random_matrix(spark, sf):
    keys = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"))
    return cells(planted.random_matrix(keys, 3, seed=11))


@query(
    "s6_group_sizes",
    """WITH t AS (SELECT count(*) // 10 AS per, (count(*) // 10) * 10 AS total FROM orders),
      s AS (SELECT per, total, ceil(total * 0.6 / 9)::BIGINT AS rest FROM t)
      SELECT g::INT AS group_id, CASE WHEN g = 0 THEN total - 9 * rest ELSE rest END AS n
      FROM s, unnest(range(10)) AS u(g)""",
)
def group_sizes(spark, sf):
    per_group = fx.table(spark, sf, "orders").count() // 10
    keys = planted.grouped_keys(spark, planted.group_sizes(10, per_group, 0.4))
    return M.label_counts(keys, "group_id")


DIRICHLET_ONE = f"""hraw AS (
  SELECT row_id, k, -ln({fx.uniform_sql('row_id', 'k', 5)}) AS e FROM keys, unnest([0, 1, 2]) AS u(k)),
  h AS (SELECT row_id, k, e / sum(e) OVER (PARTITION BY row_id) AS h FROM hraw)"""
KEYS = "keys AS (SELECT c_custkey AS row_id, (c_custkey % 5)::INT AS group_id FROM customer)"


@query(
    "s6_planted_dirichlet",
    with_(
        [
            KEYS,
            DIRICHLET_ONE,
            f"w AS (SELECT i, k, 2.0 * {fx.normal_sql('i', 'k', 3)} AS w FROM unnest(range(8)) AS a(i), unnest(range(3)) AS b(k))",
        ],
        f"SELECT row_id, i::INT AS i, {r6('sum(h * w)')} AS value FROM h JOIN w USING (k) GROUP BY row_id, i",
    ),
)
def planted_dirichlet(spark, sf):
    basis = planted.normal_basis(8, 3, scale=2.0, seed=3)
    return cells(planted.planted(fx.customer_keys(spark, sf), basis, alpha=1.0, seed=5))


@query("s6_planted_sparse", with_([KEYS], "SELECT row_id, 1.0::DOUBLE AS total, true AS nonnegative FROM keys"))
def planted_sparse(spark, sf):
    made = planted.planted(fx.customer_keys(spark, sf), planted.normal_basis(8, 4), alpha=0.1, seed=5)
    return made.select("row_id", rounded(A.row_sum("h")).alias("total"), (F.array_min("h") >= 0).alias("nonnegative"))


BANDED = """w AS (
  SELECT i, k, CASE WHEN i >= k * 5 AND i < k * 5 + 6 THEN 1.5 ELSE 0.0 END AS w
  FROM unnest(range(16)) AS a(i), unnest(range(3)) AS b(k))"""


@query(
    "s7_banded_noisy",
    with_(
        [KEYS, DIRICHLET_ONE, BANDED],
        f"""SELECT row_id, i::INT AS i,
          {r6(f"clean + [0.1, 0.1, 0.1, 0.1, 2.0][group_id + 1] * {fx.normal_sql('row_id', 'i', 6)}")} AS value
        FROM (SELECT row_id, i, sum(h * w) AS clean FROM h JOIN w USING (k) GROUP BY row_id, i)
        JOIN keys USING (row_id)""",
    ),
)
def banded_noisy(spark, sf):
    basis = planted.banded_basis(6, 3, 1, 1.5)
    made = planted.planted(fx.customer_keys(spark, sf), basis, alpha=1.0, sigmas=[0.1, 0.1, 0.1, 0.1, 2.0], seed=5)
    return cells(made)


@query(
    "s8_bernoulli_weights",
    with_(
        [
            KEYS,
            f"""raw AS (SELECT row_id, k, CASE WHEN {fx.uniform_sql('row_id', 'k', 9)} < 0.4 THEN 1.0 ELSE 0.0 END AS b
              FROM keys, unnest(range(4)) AS u(k)),
            fixed AS (SELECT row_id, k,
              CASE WHEN k = 3 AND sum(b) OVER (PARTITION BY row_id) = 0 THEN 1.0 ELSE b END AS b FROM raw)""",
        ],
        f"SELECT row_id, k::INT AS i, {r6('b / sum(b) OVER (PARTITION BY row_id)')} AS value FROM fixed",
    ),
)
def bernoulli_weights(spark, sf):
    basis = planted.banded_basis(6, 4, 1)
    return cells(planted.planted(fx.customer_keys(spark, sf), basis, weights="bernoulli", p=0.4, seed=9), "h")


@query("s9_gaussian_noise", emb_map(f"v + 0.01 * {fx.normal_sql('row_id', 'i', 4)}"))
def gaussian_noise(spark, sf):
    return cells(noise.add_gaussian(fx.emb(spark, sf), 0.01, seed=4))


NATIONS = """cust AS (SELECT c_custkey AS row_id, c_nationkey AS group_id, c_acctbal / 1000 AS v FROM customer),
  lev AS (SELECT *, CASE WHEN group_id < 7.5 THEN 0.0 WHEN group_id < 22.5 THEN 0.5 ELSE 2.0 END AS sd FROM cust)"""


def customers_by_nation(spark, sf):
    rows = fy.from_columns(
        fx.table(spark, sf, "customer").withColumn("a", F.col("c_acctbal") / 1000), ["a"], "c_custkey", "c_nationkey"
    )
    return fy.assign_groups(rows, 25, "label")


@query(
    "s10_group_mixture",
    with_([NATIONS], f"SELECT row_id, 0 AS i, {r6('v + sd * ' + fx.normal_sql('row_id', '0', 8))} AS value FROM lev"),
)
def group_mixture(spark, sf):
    return cells(noise.add_group_mixture(customers_by_nation(spark, sf), (0.0, 0.5, 2.0), (3, 6, 1), 25, seed=8))


ROW_LEVELS = f"""lev AS (
  SELECT row_id, i, v, CASE WHEN u <= 0.3 THEN 0.0 WHEN u <= 0.9 THEN 0.5 ELSE 2.0 END AS sd
  FROM (SELECT *, {fx.row_uniform_sql('row_id', 8)} AS u FROM os_cells))"""


@query(
    "s11_row_mixture",
    with_(
        [ORDERS, ORDER_CELLS, ROW_LEVELS],
        f"SELECT row_id, i, {r6('v + sd * ' + fx.normal_sql('row_id', 'i', 8))} AS value FROM lev",
    ),
)
def row_mixture(spark, sf):
    return cells(noise.add_row_mixture(fx.order_sales(spark, sf), (0.0, 0.5, 2.0), seed=8))


@query(
    "s12_noise_presets",
    f"""SELECT 'group' AS preset, CASE WHEN c_nationkey < 22.5 THEN 0.0 ELSE 1.5 END::DOUBLE AS sd, count(*) AS n
      FROM customer GROUP BY ALL
      UNION ALL SELECT 'row', CASE WHEN {fx.row_uniform_sql('c_custkey', 8)} <= 0.6 THEN 0.0 ELSE 1.5 END::DOUBLE, count(*)
      FROM customer GROUP BY ALL""",
)
def noise_presets(spark, sf):
    df = customers_by_nation(spark, sf)
    by_group = noise.group_noise_level(*noise.group_preset(1.5), groups=25)
    by_row = noise.row_noise_level(*noise.row_preset(1.5), seed=8)
    both = F.explode(
        F.array(
            F.struct(F.lit("group").alias("preset"), by_group.alias("sd")),
            F.struct(F.lit("row").alias("preset"), by_row.alias("sd")),
        )
    )
    return df.select(both.alias("l")).groupBy("l.preset", "l.sd").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s13_basis_lines",
    with_([EMB, EMB_CELLS, PARITY], "SELECT i AS feature_id, printf('%.6f %.6f', w1, w2) AS line FROM parity"),
)
def basis_lines(spark, sf):
    return delimited.basis_lines(tables.basis_table(spark, fx.parity_means(spark, sf)), " ", "%.6f")


@query(
    "s14_collected_matrix",
    with_(
        [EMB, EMB_CELLS],
        f"SELECT label AS row, i, {r6('avg(v)')} AS value FROM emb_cells GROUP BY label, i",
    ),
)
def collected_matrix(spark, sf):
    long = fx.emb(spark, sf).select(F.col("label").alias("row_id"), F.posexplode("features").alias("i", "v"))
    means = long.groupBy("row_id", "i").agg(F.avg("v").alias("v"))
    wide = means.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s"))
    rows = wide.select(F.col("row_id").cast("bigint"), F.transform("s", lambda s: s["v"]).alias("features"))
    return fx.matrix_rows(spark, to_numpy(rows), "row", "i")


# --- slices and samples -----------------------------------------------------------------------


@query(
    "p1_column_slice",
    with_([EMB, EMB_CELLS], f"SELECT row_id, i - 8 AS i, {r6('v')} AS value FROM emb_cells WHERE i >= 8 AND i < 24"),
)
def column_slice(spark, sf):
    return cells(fx.emb(spark, sf).withColumn("features", A.column_slice("features", 8, 24)))


QUARTERS = "q AS (SELECT count(*) // 4 AS a, 3 * count(*) // 4 AS b FROM orders)"


def quarters(spark, sf):
    n = fx.table(spark, sf, "orders").count()
    return n // 4, 3 * n // 4


@query(
    "p2_row_slice",
    with_(
        [QUARTERS],
        f"SELECT o_orderkey AS row_id, 0 AS i, {r6('o_totalprice', 2)} AS value FROM orders, q WHERE o_orderkey >= a AND o_orderkey < b",
    ),
)
def row_slice(spark, sf):
    rows = fy.from_columns(fx.table(spark, sf, "orders"), ["o_totalprice"], "o_orderkey")
    return cells(M.row_slice(rows, *quarters(spark, sf)))


@query(
    "p3_block_slice",
    with_(
        [ORDERS, ORDER_CELLS, QUARTERS],
        f"SELECT row_id, i - 1 AS i, {r6('v')} AS value FROM os_cells, q WHERE row_id >= a AND row_id < b AND i >= 1 AND i < 3",
    ),
)
def block_slice(spark, sf):
    return cells(M.block_slice(fx.order_sales(spark, sf), quarters(spark, sf), (1, 3)))


@query(
    "p4_pick_columns",
    with_(
        [EMB],
        f"SELECT row_id, unnest([0, 1, 2])::INT AS i, {r6('unnest([x[6], x[2], x[34]])')} AS value FROM emb",
    ),
)
def pick_columns(spark, sf):
    return cells(fx.emb(spark, sf).withColumn("features", A.pick("features", [5, 1, 33])))


@query(
    "p5_map_blocks",
    emb_map("exp(v) / sum(exp(v)) OVER (PARTITION BY row_id)"),
)
def blocks(spark, sf):
    def softmax(x):
        e = np.exp(x)
        return e / e.sum(axis=1, keepdims=True)

    return cells(map_blocks(fx.emb(spark, sf), softmax))


@query(
    "p6_bernoulli_sample",
    f"SELECT o_orderkey AS row_id, {r6('o_totalprice', 2)} AS value FROM orders WHERE {fx.row_uniform_sql('o_orderkey', 7)} < 0.02",
)
def bernoulli_sample(spark, sf):
    rows = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), rounded("o_totalprice", 2).alias("value"))
    return M.sample_rows(rows, 0.02, seed=7)


@query(
    "p7_exact_sample",
    f"""SELECT o_orderkey AS row_id, {r6('o_totalprice', 2)} AS value FROM orders
      ORDER BY {fx.row_uniform_sql('o_orderkey', 7)}, o_orderkey LIMIT 50""",
)
def exact_sample(spark, sf):
    rows = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), rounded("o_totalprice", 2).alias("value"))
    return M.sample_exact(rows, 50, seed=7)


@query("p8_persisted", EMB_LONG)
def persisted(spark, sf):
    """Cells of a persisted table; it is let go again, so that other queries scan their files."""
    df = fx.emb(spark, sf).persist()
    try:
        return write_scratch(cells(df), "persisted")
    finally:
        df.unpersist()


# --- cell functions ---------------------------------------------------------------------------


def by_op(df, *pairs):
    """Long rows ``op, row_id, i, value`` for several array expressions over one scan."""
    table = F.array(*[F.struct(F.lit(name).alias("op"), expr.alias("x")) for name, expr in pairs])
    return cells(df.select("row_id", F.explode(table).alias("t")).select("row_id", "t.op", "t.x"), "x", "op")


@query(
    "x1_scalar_ops",
    with_(
        [EMB, EMB_CELLS],
        f"SELECT row_id, unnest(['+', '-', '*', '/']) AS op, i, {r6('unnest([v + 1.5, v - 1.5, v * 3.0, v / 4.0])')} AS value FROM emb_cells",
    ),
)
def scalar_ops(spark, sf):
    ops = {"+": 1.5, "-": 1.5, "*": 3.0, "/": 4.0}
    return by_op(fx.emb(spark, sf), *[(op, A.scalar_op("features", op, v)) for op, v in ops.items()])


@query(
    "x2_power",
    with_(
        [EMB, EMB_CELLS],
        f"SELECT row_id, unnest(['2', '3']) AS op, i, {r6('unnest([pow(v, 2), pow(v, 3)])')} AS value FROM emb_cells",
    ),
)
def power(spark, sf):
    return by_op(fx.emb(spark, sf), ("2", A.power("features", 2)), ("3", A.power("features", 3)))


@query("x3_map_cells", emb_map("ln(1 + v * v) - abs(v)"))
def map_cells(spark, sf):
    df = fx.emb(spark, sf)
    return cells(df.withColumn("features", A.map_cells("features", lambda x: F.log(1 + x * x) - F.abs(x))))


@query(
    "x4_add_subtract",
    with_(
        [EMB, EMB_CELLS],
        f"SELECT row_id, unnest(['+', '-']) AS op, i, {r6(f'unnest([v + s, v - s])')} AS value FROM (SELECT *, {soft_sql('v', '0.1')} AS s FROM emb_cells)",
    ),
)
def add_subtract(spark, sf):
    a = fx.emb(spark, sf)
    b = a.withColumn("features", A.soft_threshold("features", 0.1))
    pairs = M.paired(a, b, "features")
    return by_op(pairs, *[(op, A.zip_op(F.col("_a"), F.col("_b"), op)) for op in ("+", "-")])


@query("x5_soft_threshold", emb_map(soft_sql("v", "0.1")))
def soft_threshold(spark, sf):
    return cells(fx.emb(spark, sf).withColumn("features", A.soft_threshold("features", 0.1)))


@query("x6_clamp", emb_map("greatest(v, 1e-5)"))
def clamp(spark, sf):
    return cells(fx.emb(spark, sf).withColumn("features", A.clamp_below("features", 1e-5)))


@query(
    "x7_positive_part_norm",
    with_([EMB, EMB_CELLS], f"SELECT row_id, {r6('sqrt(sum(pow(greatest(v, 0.0), 2)))')} AS value FROM emb_cells GROUP BY row_id"),
)
def positive_part_norm(spark, sf):
    return fx.emb(spark, sf).select("row_id", rounded(A.positive_part_norm("features")).alias("value"))


@query(
    "x8_about_equal",
    with_(
        [EMB, EMB_CELLS],
        f"""SELECT {r6('max(abs(d))')} AS max_abs_diff, max(abs(d)) < tol AS equal
          FROM (SELECT v - {soft_sql('v', '0.1')} AS d, unnest([0.05, 0.5]) AS tol FROM emb_cells) GROUP BY tol""",
    ),
)
def about_equal(spark, sf):
    a = fx.emb(spark, sf)
    b = a.withColumn("features", A.soft_threshold("features", 0.1))
    tests = M.about_equal(a, b, 0.05).unionByName(M.about_equal(a, b, 0.5))
    return tests.withColumn("max_abs_diff", rounded("max_abs_diff"))


