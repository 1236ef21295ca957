"""Delimited text: one instance per line, optionally led by its label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def parse_lines(
    lines: DataFrame, delimiter: str = ",", has_label: bool = False, value: str = "value", key: str | Column = "row_id"
) -> DataFrame:
    """Split text lines into feature rows.

    ``delimiter`` is a regular expression and trailing empty fields are dropped. With
    ``has_label`` the first field is read as a double and truncated to an int; otherwise the
    label is -1. A field that is no number raises, as in ANSI mode.
    """
    trimmed = F.regexp_replace(F.col(value), f"(?:{delimiter})+$", "")
    numbers = F.transform(F.split(trimmed, delimiter), lambda x: F.trim(x).cast("double"))
    row_id = (F.col(key) if isinstance(key, str) else key).cast("bigint").alias("row_id")
    parsed = lines.select(row_id, numbers.alias("_numbers"))
    if has_label:
        label = F.get("_numbers", F.lit(0)).cast("int")
        features = F.slice("_numbers", F.lit(2), F.size("_numbers") - 1)
    else:
        label, features = F.lit(-1).cast("int"), F.col("_numbers")
    return parsed.select("row_id", features.alias("features"), label.alias("label"))


def read_delimited(spark: SparkSession, path: str, delimiter: str = ",", has_label: bool = False) -> DataFrame:
    """Read delimited text files. Text has no key: ``row_id`` is a line's number, from 0, files in order of path.

    Lines are numbered within each split of a file, and splits get their first number from prefix sums over their counts, one small row
    each. The numbers do not depend on how files are split. The lines are scanned once more to count them.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_place"),
    )
    splits = lines.groupBy("_path", "_start").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_path", "_start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = splits.select("_path", "_start", (before - F.col("_first")).alias("_shift"))
    numbered = lines.join(first, ["_path", "_start"]).withColumn("row_id", F.col("_place") + F.col("_shift"))
    return parse_lines(numbered, delimiter, has_label)


def basis_lines(basis: DataFrame, separator: str = " ", pattern: str | None = None) -> DataFrame:
    """``feature_id, line``: one text line per feature of a basis table."""
    text = F.transform("w", lambda x: F.format_string(pattern, x) if pattern else x.cast("string"))
    return basis.select("feature_id", F.concat_ws(separator, text).alias("line"))


def write_basis(basis: DataFrame, path: str, separator: str = " ") -> None:
    """Write a basis as one delimited text file, in feature order (its size is features x rank)."""
    ordered = basis_lines(basis, separator).repartition(1).sortWithinPartitions("feature_id")
    ordered.select("line").write.mode("errorifexists").text(path)
