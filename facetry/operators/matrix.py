"""Row selection, sampling, pairing and reductions of a feature table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays as A

_REDUCERS = {
    "sum": (A.row_sum, F.sum),
    "prod": (A.row_product, F.product),
    "min": (A.row_min, F.min),
    "max": (A.row_max, F.max),
}


def row_slice(df: DataFrame, start: int, stop: int) -> DataFrame:
    """Rows with start <= row_id < stop; the filter is pushed to the scan. ``number_rows`` makes keys 0, 1, ... for slices by place."""
    return df.filter((F.col("row_id") >= int(start)) & (F.col("row_id") < int(stop)))


def block_slice(df: DataFrame, rows: tuple[int, int], columns: tuple[int, int]) -> DataFrame:
    return row_slice(df, *rows).withColumn("features", A.column_slice("features", *columns))


def sample_rows(df: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """Bernoulli sample that depends on row keys only."""
    return df.filter(A.row_uniform("row_id", seed) < F.lit(float(fraction)))


def sample_exact(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, as a distributed top-n by hashed key."""
    return df.orderBy(A.row_uniform("row_id", seed), "row_id").limit(int(n))


def combine(left: DataFrame, right: DataFrame, op: str) -> DataFrame:
    """Cell by cell ``left op right`` for tables with the same keys and width.

    A key missing on one side or there more than once, or a pair of different width, raises while the join runs.
    """
    return paired(left, right, "features").select("row_id", A.zip_op(F.col("_a"), F.col("_b"), op).alias("features"))


def keyed_once(df: DataFrame, key: str = "row_id") -> DataFrame:
    """The table, raising where a key is null or occurs twice as soon as one of its other columns is read.

    The key itself stays as it is, so that the count's exchange serves a join by this key as well.
    """
    times = F.count(F.lit(1)).over(W.partitionBy(key))
    message = F.concat(F.lit(f"{key} is null or occurs more than once: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    checked = df.withColumn("_times", times)
    fine = F.col(key).isNotNull() & (F.col("_times") == 1)
    others = [F.when(fine, F.col(c)).otherwise(F.raise_error(message).cast(df.schema[c].dataType)).alias(c) for c in df.columns if c != key]
    return checked.select(key, *others)


def paired(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """``row_id, _a, _b``: the arrays of two tables by key, which must be the same and unique, and of one length."""
    a = keyed_once(left.select("row_id", F.col(column).alias("_a")))
    b = keyed_once(right.select("row_id", F.col(column).alias("_b")))
    fits = F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.size("_a") == F.size("_b"))
    broken = F.raise_error(F.concat(F.lit("tables do not line up at row_id "), F.col("row_id").cast("string")))
    return a.join(b, "row_id", "full_outer").withColumn("_a", F.when(fits, F.col("_a")).otherwise(broken))


def about_equal(left: DataFrame, right: DataFrame, tol: float = 1e-8) -> DataFrame:
    """One row ``max_abs_diff, equal``; large negative differences count too."""
    worst = F.max(F.array_max(F.transform(F.col("features"), F.abs)))
    return combine(left, right, "-").agg(worst.alias("max_abs_diff")).withColumn(
        "equal", F.coalesce(F.col("max_abs_diff"), F.lit(0.0)) < F.lit(float(tol))
    )



def dims(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(F.size("features")).cast("int").alias("n_cols")
    ).withColumn("n_cells", F.col("n_rows") * F.col("n_cols"))


def fold_cells(
    df: DataFrame,
    zero: float,
    seq: Callable[[Column, Column], Column],
    combine_with: Callable[[Column], Column] = F.sum,
) -> DataFrame:
    """Fold each row with ``seq`` from ``zero``, then combine the rows with an aggregate function."""
    return df.agg(combine_with(A.fold("features", zero, seq)).alias("value"))


def reduce_cells(df: DataFrame, *how: str) -> DataFrame:
    """One row with a column per reducer (sum, prod, min, max) over all cells; no hidden starting zero."""
    return df.agg(*[_REDUCERS[h][1](_REDUCERS[h][0]("features")).alias(h) for h in how])


def reduce_rows(df: DataFrame, *how: str) -> DataFrame:
    """``row_id`` and a column per reducer."""
    return df.select("row_id", *[_REDUCERS[h][0]("features").alias(h) for h in how])


def reduce_columns(df: DataFrame, *how: str, cell: Callable[[Column], Column] | None = None) -> DataFrame:
    """``feature_id`` and a column per reducer: one hash aggregate over exploded cells.

    Each task combines its cells to one row per feature before the shuffle.
    """
    cells = df.select(F.posexplode("features").alias("feature_id", "_x"))
    x = F.col("_x") if cell is None else cell(F.col("_x"))
    return cells.groupBy("feature_id").agg(*[_REDUCERS[h][1](x).alias(h) for h in how])


def row_sums(df: DataFrame) -> DataFrame:
    return reduce_rows(df, "sum")


def column_sums(df: DataFrame) -> DataFrame:
    return reduce_columns(df, "sum")


def column_l1_norms(df: DataFrame) -> DataFrame:
    """``feature_id, norm``."""
    return reduce_columns(df, "sum", cell=F.abs).withColumnRenamed("sum", "norm")


def norms(df: DataFrame) -> DataFrame:
    """Squared, Frobenius and mean-scaled Frobenius norm of the whole table, in one pass."""
    totals = df.agg(F.sum(A.row_sumsq("features")).alias("squared"), F.sum(F.size("features")).alias("_cells"))
    return totals.select(
        "squared",
        F.sqrt("squared").alias("frobenius"),
        (F.sqrt("squared") / F.sqrt(F.col("_cells").cast("double"))).alias("mean_scaled"),
    )


def sparseness(df: DataFrame) -> DataFrame:
    """Hoyer's measure (sqrt(n) - l1/l2) / (sqrt(n) - 1) over all cells."""
    totals = df.agg(
        F.sum(A.row_abs_sum("features")).alias("l1"),
        F.sqrt(F.sum(A.row_sumsq("features"))).alias("l2"),
        F.sqrt(F.sum(F.size("features")).cast("double")).alias("root"),
    )
    return totals.select(((F.col("root") - F.col("l1") / F.col("l2")) / (F.col("root") - 1.0)).alias("sparseness"))


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def relative_change(old: DataFrame, new: DataFrame) -> DataFrame:
    """||old - new|| / ||old|| of two weight tables; keys that are not the same and unique raise."""
    gap = F.zip_with("_a", "_b", lambda x, y: (x - y) * (x - y))
    return paired(old, new, "h").agg(
        (F.sqrt(F.sum(A.row_sum(gap))) / F.sqrt(F.sum(A.row_sumsq("_a")))).alias("relative_change")
    )
