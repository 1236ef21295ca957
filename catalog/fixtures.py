"""Feature tables built from the test tables, in Spark and in SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import facetry as fy
from facetry.operators.blocks import small_table

GROUPS = 5
# Event types in the order of their feature positions.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return fy.ship_package(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings: 64 signed features per row, five groups by key."""
    source = table(spark, sf_dir, "embeddings")
    return fy.assign_groups(fy.from_array(source, "embedding", "vec_id", "label"), GROUPS, F.col("row_id") % GROUPS)


def emb_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with rank-2 weights (t, 1 - t), t = (s / 8 + 1) / 2 for the sum s of all cells (at most 8 in size for unit vectors)."""
    t = (F.aggregate("features", F.lit(0.0), lambda a, x: a + x) / 8 + 1) / 2
    return emb(spark, sf_dir).withColumn("h", F.array(t, 1 - t))


def order_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: quantity / 100, price / 333333, discount, tax, each summed over its lines."""
    lines = table(spark, sf_dir, "lineitem")
    sums = lines.groupBy("l_orderkey").agg(
        (F.sum("l_quantity") / 100).alias("quantity"),
        (F.sum("l_extendedprice") / 333333).alias("price"),
        F.sum("l_discount").alias("discount"),
        F.sum("l_tax").alias("tax"),
    )
    rows = fy.from_columns(sums, ["quantity", "price", "discount", "tax"], "l_orderkey")
    return fy.assign_groups(rows, GROUPS, F.col("row_id") % GROUPS)


def order_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order sales with two features (quantity, price) and the other two as targets."""
    return order_sales(spark, sf_dir).select(
        "row_id",
        "group_id",
        F.slice("features", 1, 2).alias("features"),
        F.get("features", F.lit(2)).alias("discount"),
        F.get("features", F.lit(3)).alias("tax"),
    )


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: summed value / 1000 by event type, five features."""
    events = table(spark, sf_dir, "events")
    at = F.lit(None).cast("int")
    for k, name in enumerate(EVENT_TYPES):
        at = F.when(F.col("event_type") == name, F.lit(k)).otherwise(at)
    cells = events.select("user_id", at.alias("at"), (F.col("value") / 1000).alias("v"))
    return fy.assign_groups(
        fy.from_dense_rows(cells, "user_id", "at", "v", len(EVENT_TYPES)), GROUPS, F.col("row_id") % GROUPS
    )


def customer_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row keys of the customers, with five groups by key."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id"))
    return fy.assign_groups(rows, GROUPS, F.col("row_id") % GROUPS)


def parity_means(spark: SparkSession, sf_dir: str) -> np.ndarray:
    """A 64 x 2 basis: the mean embedding of even and of odd labels."""
    cells = emb(spark, sf_dir).select((F.col("label") % 2).alias("k"), F.posexplode("features").alias("i", "v"))
    means = cells.groupBy("i", "k").agg(F.avg("v").alias("v")).toArrow()
    basis = np.zeros((int(max(means.column("i").to_numpy())) + 1, 2))
    basis[means.column("i").to_numpy(), means.column("k").to_numpy()] = means.column("v").to_numpy()
    return basis


def rounded(c: str | Column, digits: int = 6) -> Column:
    """Rounded, and never -0.0."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def cells(df: DataFrame, column: str = "features", *keep: str, key: str = "row_id") -> DataFrame:
    """Long, rounded rows ``key, ..., i, value``."""
    # The outer variant keeps the optimiser from adding a filter that evaluates the array a second time; arrays are not empty here.
    return df.select(key, *keep, F.posexplode_outer(column).alias("i", "value")).withColumn("value", rounded("value"))


def matrix_rows(spark: SparkSession, block: np.ndarray, *names: str) -> DataFrame:
    """A small result matrix as rows ``names..., value`` (one name per axis)."""
    axes = np.indices(block.shape).reshape(block.ndim, -1)
    rows = list(zip(*[a.tolist() for a in axes], block.ravel().tolist()))
    schema = ", ".join(f"{n} int" for n in names) + ", value double"
    return small_table(spark, rows, schema).withColumn("value", rounded("value"))


# --- SQL counterparts -------------------------------------------------------------------------

EMB = "emb AS (SELECT vec_id AS row_id, (vec_id % 5)::INT AS group_id, embedding::DOUBLE[] AS x, label FROM embeddings)"
EMB_CELLS = """emb_cells AS (
  SELECT row_id, group_id, label, unnest(range(len(x)))::INT AS i, unnest(x) AS v FROM emb)"""
EMB_H = "emb_h AS (SELECT row_id, group_id, x, (list_sum(x) / 8 + 1) / 2 AS h1, 1 - (list_sum(x) / 8 + 1) / 2 AS h2 FROM emb)"
PARITY = """parity AS (
  SELECT i, avg(CASE WHEN label % 2 = 0 THEN v END) AS w1, avg(CASE WHEN label % 2 = 1 THEN v END) AS w2
  FROM emb_cells GROUP BY i)"""
ORDERS = """os AS (
  SELECT l_orderkey AS row_id, (l_orderkey % 5)::INT AS group_id, sum(l_quantity) / 100 AS x0,
    sum(l_extendedprice) / 333333 AS x1, sum(l_discount) AS x2, sum(l_tax) AS x3
  FROM lineitem GROUP BY l_orderkey)"""
ORDER_CELLS = """os_cells AS (
  SELECT row_id, group_id, unnest([0, 1, 2, 3])::INT AS i, unnest([x0, x1, x2, x3]) AS v FROM os)"""
USERS = "ue AS (\n  SELECT user_id AS row_id, (user_id % 5)::INT AS group_id,\n    " + ",\n    ".join(
    f"sum(CASE WHEN event_type = '{name}' THEN value / 1000 ELSE 0 END) AS x{k}" for k, name in enumerate(EVENT_TYPES)
) + "\n  FROM events GROUP BY user_id)"
USER_CELLS = """ue_cells AS (
  SELECT row_id, group_id, unnest(range(5))::INT AS i, unnest([x0, x1, x2, x3, x4]) AS v FROM ue)"""


def with_(ctes: list[str], body: str) -> str:
    recursive = "RECURSIVE " if any("-- recursive" in c for c in ctes) else ""
    return f"WITH {recursive}" + ",\n".join(ctes) + "\n" + body


def r6(expression: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0"


def soft_sql(a: str, t: str) -> str:
    return f"(CASE WHEN ({a}) > ({t}) THEN ({a}) - ({t}) WHEN ({a}) < -({t}) THEN ({a}) + ({t}) ELSE 0.0 END)"


def uniform_sql(row: str, slot: str, seed: int) -> str:
    """The counter-based uniform of ``facetry.functions.counter`` in exact integer arithmetic."""
    from facetry.functions.counter import KEY_ROW, KEY_SEED, KEY_SLOT, MIX_A, MIX_B

    two64 = "18446744073709551616::UHUGEINT"
    z = (
        f"((({row})::UHUGEINT * {KEY_ROW}::UHUGEINT) % {two64} + (({slot})::UHUGEINT * {KEY_SLOT}::UHUGEINT) % {two64}"
        f" + {(seed * KEY_SEED) % 2**64}::UHUGEINT) % {two64}"
    )
    a = f"list_transform([({z})], lambda z: (xor(z, z >> 30) * {MIX_A}::UHUGEINT) % {two64})"
    b = f"list_transform({a}, lambda z: (xor(z, z >> 27) * {MIX_B}::UHUGEINT) % {two64})"
    c = f"list_transform({b}, lambda z: (((xor(z, z >> 31) >> 11)::DOUBLE + 0.5) / 9007199254740992.0))"
    return f"({c})[1]"


def normal_sql(row: str, slot: str, seed: int) -> str:
    u = uniform_sql(row, f"2 * ({slot})", seed)
    v = uniform_sql(row, f"2 * ({slot}) + 1", seed)
    return f"(sqrt(-2.0 * ln({u})) * cos(2.0 * pi() * {v}))"


def row_uniform_sql(row: str, seed: int) -> str:
    return f"(('0x' || substr(md5(({row})::VARCHAR || ':{seed}'), 1, 13))::UBIGINT / 4503599627370496.0)"
