"""Choice of extreme columns for separable non-negative factorisation.

The greedy choice needs the Gram matrix C = X'X only, so the rows are read once whatever the rank.
Small C is searched on the driver; a wide C stays a table of rows and each pick is one aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import check_cells, dense, vector
from .group_stats import TILE, gram
from .weights import nonnegative_minimiser


def column_scores(rows: np.ndarray, own: np.ndarray, chosen: list[int], weights: np.ndarray) -> np.ndarray:
    """||positive part of (C_j - H' C_Sj)|| / sqrt(C_jj) for given rows (= columns) of C.

    ``weights`` is H (width x |S|), one row per column of X. An all-zero column scores -1.
    """
    residual = rows - rows[:, chosen] @ weights.T if chosen else rows
    size = np.sqrt(np.square(np.maximum(residual, 0.0)).sum(axis=1))
    return np.where(own > 0, size / np.sqrt(np.where(own > 0, own, 1.0)), -1.0)


def column_weights(c: np.ndarray, chosen: list[int]) -> np.ndarray:
    """argmin_{H>=0} ||X - X_S H||_F from the Gram matrix; shape (|S|, width)."""
    return nonnegative_minimiser(c[:, chosen], c[np.ix_(chosen, chosen)]).T


def choose_columns(c: np.ndarray, rank: int) -> tuple[list[int], np.ndarray]:
    """(column indices in order of choice, H). Ties: lowest index first, highest index afterwards."""
    chosen: list[int] = []
    h = np.zeros((0, c.shape[0]))
    for _ in range(rank):
        scores = column_scores(c, np.diagonal(c), chosen, h.T)
        scores[chosen] = -np.inf
        best = np.flatnonzero(scores == scores.max())
        chosen.append(int(best[-1] if chosen else best[0]))
        h = column_weights(c, chosen)
    return chosen, h


def gram_rows(df: DataFrame, tile: int = TILE) -> DataFrame:
    """C as ``i, features`` rows, for widths whose square is too large for the driver; made from tiles."""
    cells = F.array_sort(F.collect_list(F.struct("j", "value")))
    return gram(df, tile=tile).groupBy("i").agg(F.transform(cells, lambda s: s["value"]).alias("features"))


def choose_columns_wide(c_rows: DataFrame, width: int, rank: int) -> tuple[list[int], np.ndarray]:
    """The same choice on a table of rows of C: per pick, one scoring map with a top-1."""
    check_cells(width * rank, 20_000_000, "the column weights")
    chosen: list[int] = []
    h = np.zeros((0, width))
    for _ in range(rank):
        best = top_column(c_rows, chosen, h)
        chosen.append(best)
        picked = c_rows.filter(F.col("i").isin(chosen)).toArrow().combine_chunks()
        block = dense(picked.to_batches()[0])
        at = {int(i): k for k, i in enumerate(picked.column("i").to_numpy())}
        block = block[[at[s] for s in chosen]]
        h = nonnegative_minimiser(block.T, block[:, chosen]).T
    return chosen, h


def top_column(c_rows: DataFrame, chosen: list[int], h: np.ndarray) -> int:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            i, rows = vector(batch, "i"), dense(batch)
            scores = column_scores(rows, rows[np.arange(len(i)), i], chosen, h.T)
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(scores)], names=["i", "score"])

    scored = c_rows.select("i", "features").mapInArrow(run, "i int, score double")
    if chosen:
        scored = scored.filter(~F.col("i").isin(chosen))
    tie = F.col("i").desc() if chosen else F.col("i").asc()
    return int(scored.orderBy(F.col("score").desc(), tie).first()["i"])
