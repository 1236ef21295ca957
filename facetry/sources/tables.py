"""Feature tables: ``row_id BIGINT, group_id INT, features ARRAY<DOUBLE>, label INT``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.blocks import small_table
from ..session import write_scratch


NARROW = 128


def _key(key: str | Column) -> Column:
    return (F.col(key) if isinstance(key, str) else key).cast("bigint").alias("row_id")


def from_columns(
    df: DataFrame, columns: Sequence[str | Column], key: str | Column, label: str | Column | None = None
) -> DataFrame:
    """One feature per numeric column (cast to double); column pruning reaches the scan."""
    cells = [(F.col(c) if isinstance(c, str) else c).cast("double") for c in columns]
    return df.select(_key(key), F.array(*cells).alias("features"), _label(label))


def from_array(
    df: DataFrame, features: str | Column, key: str | Column, label: str | Column | None = None
) -> DataFrame:
    """Features from an array column of any numeric type."""
    c = F.col(features) if isinstance(features, str) else features
    return df.select(_key(key), c.cast("array<double>").alias("features"), _label(label))


def _label(label: str | Column | None) -> Column:
    if label is None:
        return F.lit(-1).cast("int").alias("label")
    return (F.col(label) if isinstance(label, str) else label).cast("int").alias("label")


def from_dense_rows(df: DataFrame, key: str, position: str, value: str, width: int) -> DataFrame:
    """Gather long rows ``(key, position 0..width-1, value)`` into feature rows; gaps become 0.

    A position that is null or not in 0..width-1 raises, with its key. Partial aggregation runs before the shuffle, so one hot
    key is combined in every task that sees it: by one conditional sum per feature where these fit generated code, else by
    sums per (key, position), of which each key then has at most ``width``.
    """
    at, k = F.col(position), F.col(key).cast("bigint")
    where = F.concat(F.lit("position "), F.coalesce(at.cast("string"), F.lit("null")), F.lit(f" is not in 0..{width - 1} at key "), k.cast("string"))
    inside = F.coalesce((at >= 0) & (at < width), F.lit(False))
    rows = df.select(k.alias("row_id"), F.when(inside, at).otherwise(F.raise_error(where).cast("int")).alias("at"), F.col(value).cast("double").alias("v"))
    if width <= NARROW:
        cells = [F.sum(F.when(F.col("at") == i, F.col("v")).otherwise(0.0)) for i in range(width)]
        return rows.groupBy("row_id").agg(F.array(*cells).alias("features"), F.lit(-1).cast("int").alias("label"))
    sums = rows.groupBy("row_id", "at").agg(F.sum("v").alias("v"))
    held = sums.groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("held"))
    features = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at("held", i), F.lit(0.0)))
    return held.select("row_id", features.alias("features"), F.lit(-1).cast("int").alias("label"))


def assign_groups(df: DataFrame, groups: int, by: str | Column | None = None) -> DataFrame:
    """Attach ``group_id``: a given expression, or ``groups`` even classes of the row key.

    Groups are logical; no shuffle happens and a group may span any number of tasks.
    """
    if by is not None:
        gid = F.col(by) if isinstance(by, str) else by
    else:
        gid = F.pmod(F.hash("row_id"), F.lit(int(groups)))
    return df.withColumn("group_id", gid.cast("int"))


def spread_groups(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Optional layout for very many groups: rows of a group lie together, large groups are split.

    The passes of this package are right on any layout. With thousands of groups a task that sees
    all of them emits a partial sum for each; clustering first makes those partials fewer. Groups are counted
    first; one larger than a quarter of an even partition is salted by row key into as many parts as
    it takes, so a group with a third of the table fills many partitions. The list of large groups has at most four
    entries per partition, which is what makes its broadcast safe.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = df.groupBy("group_id").agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    part = max(1, total // (4 * n))
    large = sizes.filter(F.col("_n") > part).select("group_id", F.ceil(F.col("_n") / part).cast("int").alias("_salts"))
    marked = df.join(F.broadcast(large), "group_id", "left")
    salt = F.pmod(F.hash("row_id"), F.coalesce("_salts", F.lit(1)))
    return marked.repartition(n, F.col("group_id"), salt).select(*df.columns)


def number_rows(df: DataFrame, order_by: str | Sequence[str], name: str = "row_id") -> DataFrame:
    """Rows numbered 0, 1, ... in an order, without a window over all rows; the numbered table lies in the scratch folder.

    A range sort deals the rows to partitions in order; each gets its first number from prefix sums over the partitions' counts. Rows and
    their places are written once, to the session's checkpoint folder, so that counts and rows come from the same sort. Ties have no
    particular order. An existing column of this name is replaced.
    """
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    ordered = df.orderBy(*keys).withColumn("_place", F.monotonically_increasing_id())
    placed = write_scratch(ordered, "numbered")
    part, within = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = counts.select("_part", before.alias("_before"))
    joined = placed.withColumn("_part", part).join(first, "_part")
    return joined.withColumn(name, F.col("_before") + within).drop("_part", "_place", "_before")


def feature_width(df: DataFrame, column: str = "features") -> int:
    """Number of features, taken from one row (fetches a single row)."""
    row = df.select(F.size(column)).first()
    if row is None:
        raise ValueError("the feature table is empty")
    return int(row[0])


def check_width(df: DataFrame, width: int, column: str = "features") -> DataFrame:
    """Fail, naming the row, where a feature array is null or has another length.

    Evaluated as part of the scan that uses the features; there is no pass of its own. A null inside an
    array fails later, where the cells become a block.
    """
    c = F.col(column)
    ok = F.size(c) == F.lit(int(width))
    message = F.concat(F.lit(f"expected {width} features at row_id "), F.col("row_id").cast("string"))
    return df.withColumn(column, F.when(ok, c).otherwise(F.raise_error(message)))


def basis_table(spark, basis) -> DataFrame:
    """A basis matrix (features x rank) as ``feature_id INT, w ARRAY<DOUBLE>``."""
    rows = [(i, [float(v) for v in w]) for i, w in enumerate(basis)]
    return small_table(spark, rows, "feature_id int, w array<double>")
