"""Comparison of predicted with true classes: contingency, one-to-one matching, accuracy, F1."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_scratch
from .blocks import TooLarge, check_cells, small_table
from .matching import auction, partner_table
from .matrix import keyed_once


def label_pairs(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """``row_id, true_label, pred_label`` by key; a key on one side only, or twice on a side, raises."""
    paired = keyed_once(truth.select("row_id", "true_label")).join(
        keyed_once(predicted.select("row_id", "pred_label")), "row_id", "full_outer"
    )
    lost = F.raise_error(F.concat(F.lit("labels do not line up at row_id "), F.col("row_id").cast("string")))
    both = F.col("true_label").isNotNull() & F.col("pred_label").isNotNull()
    return paired.select(
        "row_id",
        F.when(both, F.col("true_label")).otherwise(lost.cast("int")).alias("true_label"),
        "pred_label",
    )


def joint_counts(pairs: DataFrame) -> DataFrame:
    """``true_label, pred_label, n`` of the pairs that occur."""
    return pairs.groupBy("true_label", "pred_label").agg(F.count(F.lit(1)).alias("n"))


def contingency(pairs: DataFrame, max_cells: int = 4_000_000) -> DataFrame:
    """``true_label, pred_label, n`` with zeros for pairs that never occur.

    Rows are joined and counted once, by one aggregate; the counted table is fetched after a check of its size and filled here. More
    than ``max_cells`` true times predicted classes raise (``joint_counts`` has no such limit).
    """
    true_labels, pred_labels, counts = count_matrix(joint_counts(pairs), max_cells)
    rows = [(int(t), int(p), int(counts[i, j])) for i, t in enumerate(true_labels) for j, p in enumerate(pred_labels)]
    return small_table(pairs.sparkSession, rows, "true_label int, pred_label int, n bigint")


def count_matrix(table: DataFrame, max_cells: int, max_classes: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(true labels, predicted labels, matrix of counts) of a counted table, checked before the transfer and before the matrix is made.

    At most one row more than allowed is fetched, by one job, so that the rows behind the table are joined and counted once.
    """
    cells = table.limit(max_cells + 1).toArrow()
    if cells.num_rows > max_cells:
        raise TooLarge(f"the contingency table has more than {max_cells} pairs of classes that occur")
    t, p, n = (cells.column(c).to_numpy() for c in ("true_label", "pred_label", "n"))
    true_labels, ti = np.unique(t, return_inverse=True)
    pred_labels, pi = np.unique(p, return_inverse=True)
    check_cells(len(true_labels) * len(pred_labels), max_cells, "the contingency table")
    if max_classes is not None and max(len(true_labels), len(pred_labels)) > max_classes:
        raise TooLarge(f"{max(len(true_labels), len(pred_labels))} classes are more than the {max_classes} that are matched")
    counts = np.zeros((len(true_labels), len(pred_labels)))
    counts[ti, pi] = n
    return true_labels, pred_labels, counts


def assignment(cost: np.ndarray) -> np.ndarray:
    """Column for each row of a cost matrix, minimising the total (shortest augmenting paths).

    With more rows than columns the rows left over get -1.
    """
    rows, columns = cost.shape
    k = max(rows, columns)
    square = np.full((k, k), cost.max() if cost.size else 0.0)
    square[:rows, :columns] = cost
    row_price, col_price = np.zeros(k), np.zeros(k)
    owner = np.full(k, -1)
    for start in range(k):
        reach = np.full(k, np.inf)
        via = np.full(k, -1)
        seen = np.zeros(k, dtype=bool)
        row, end = start, -1
        base = 0.0
        while end < 0:
            slack = base + square[row] - row_price[row] - col_price
            closer = ~seen & (slack < reach)
            reach[closer], via[closer] = slack[closer], row
            column = int(np.argmin(np.where(seen, np.inf, reach)))
            base = reach[column]
            seen[column] = True
            if owner[column] < 0:
                end = column
            else:
                row = int(owner[column])
        settled = np.flatnonzero(seen)
        row_price[start] += base
        for column in settled:
            if owner[column] >= 0:
                row_price[owner[column]] += base - reach[column]
            col_price[column] -= base - reach[column]
        while end >= 0:
            row = int(via[end])
            previous = np.flatnonzero(owner == row)
            owner[end] = row
            end = int(previous[0]) if previous.size and row != start else -1
    match = np.empty(k, dtype=int)
    match[owner] = np.arange(k)
    match = match[:rows]
    return np.where(match < columns, match, -1)


def match_classes(table: DataFrame, max_classes: int = 2000) -> DataFrame:
    """One-to-one matching of classes: ``true_label, pred_label, n, n_true, n_pred, total``.

    Minimises the sum of 1 / (1 + n_ij / total), which is not the matching of highest accuracy.
    ``table`` is a contingency table, zeros filled or not. With more than ``max_classes`` classes on either side an auction over the pairs that
    occur takes the place of the dense matrix, see ``match_many_classes``: the same total cost within a proven gap.
    A true class without a partner has a null ``pred_label`` and n = 0. Equal rows of cost are resolved by label order.
    """
    spark = table.sparkSession
    try:
        true_labels, pred_labels, counts = count_matrix(table, max_classes**2, max_classes)
    except TooLarge:
        return match_many_classes(table)
    total = counts.sum()
    partner = assignment(1.0 / (1.0 + counts / total))
    rows = [
        (
            int(label),
            int(pred_labels[j]) if j >= 0 else None,
            int(counts[i, j]) if j >= 0 else 0,
            int(counts[i].sum()),
            int(counts[:, j].sum()) if j >= 0 else 0,
            int(total),
        )
        for i, (label, j) in enumerate(zip(true_labels, partner))
    ]
    return small_table(
        spark, rows, "true_label int, pred_label int, n bigint, n_true bigint, n_pred bigint, total bigint"
    )


def match_many_classes(table: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """``match_classes`` for any number of classes: an auction over the pairs of classes that occur, without a matrix of all pairs.

    A pair that never occurs costs 1 and so gains nothing over staying single; classes that the auction leaves single are paired in
    order of their labels, as far as there are any on both sides. The counted table is kept for the rounds, the result lies in the scratch folder.
    """
    counts = table.persist()
    try:
        total = int(counts.agg(F.sum("n")).first()[0] or 0)
        found = auction(counts, f"n / ({total} + n)", tolerance)
        lone_rows = np.flatnonzero(found.partner < 0)
        lone_columns = np.setdiff1d(np.arange(len(found.columns)), found.partner)
        partner = found.partner.copy()
        both = min(len(lone_rows), len(lone_columns))
        partner[lone_rows[:both]] = lone_columns[:both]
        true_sums = counts.groupBy("true_label").agg(F.sum("n").alias("n_true"))
        pred_sums = counts.groupBy("pred_label").agg(F.sum("n").alias("n_pred"))
        pairs = partner_table(counts, found.rows, found.columns, partner)
        matched = true_sums.join(pairs, "true_label", "left").join(pred_sums, "pred_label", "left").join(counts, ["true_label", "pred_label"], "left")
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        return write_scratch(matched.select("true_label", "pred_label", zero("n"), "n_true", zero("n_pred"), F.lit(total).cast("bigint").alias("total")), "matched")
    finally:
        counts.unpersist()


def accuracy(matching: DataFrame) -> DataFrame:
    return matching.agg((F.sum("n") / F.max("total")).alias("accuracy"))


def f_measure(matching: DataFrame) -> DataFrame:
    """``f1``: mean F1 over matched pairs with any overlap; ``f1_of_means``: F1 of mean precision and recall."""
    precision = F.when(F.col("n_pred") > 0, F.col("n") / F.col("n_pred")).otherwise(0.0)
    recall = F.when(F.col("pred_label").isNotNull(), F.col("n") / F.col("n_true")).otherwise(0.0)
    scored = matching.select(precision.alias("p"), recall.alias("r"))
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r")))
    means = scored.agg(F.avg(f1).alias("f1"), F.avg("p").alias("_p"), F.avg("r").alias("_r"))
    combined = F.when(F.col("_p") + F.col("_r") > 0, 2 * F.col("_p") * F.col("_r") / (F.col("_p") + F.col("_r")))
    return means.select("f1", combined.alias("f1_of_means"))
