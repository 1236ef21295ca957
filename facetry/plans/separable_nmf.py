"""Separable non-negative factorisation: W is made of columns of X."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import argmax, pick
from ..operators.blocks import TooLarge
from ..operators.extreme_columns import choose_columns, choose_columns_wide, gram_rows
from ..operators.group_stats import gram_and_norms
from ..operators.matrix import column_l1_norms
from ..operators.tsqr import r_matrix
from ..sources.tables import feature_width


@dataclass
class SeparableNMF:
    """Chosen columns, their weights H (rank x width), and column L1 norms."""

    columns: list[int]
    h: np.ndarray
    norms: np.ndarray
    normalized: bool

    def loadings(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """``row_id, h``: the chosen columns of every row (not collected), with columns to keep."""
        w = pick("features", self.columns)
        if self.normalized:
            scales = F.lit(np.asarray([self.norms[j] for j in self.columns], dtype=float))
            w = F.zip_with(w, scales, lambda x, s: F.when(s > 0, x / s).otherwise(0.0))
        return df.select("row_id", *keep, w.alias("h"))

    def labels(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """``row_id, pred_label``: 0-based position of the largest loading; columns to keep come between."""
        return self.loadings(df, keep).select("row_id", *keep, argmax("h", base=0).alias("pred_label"))


def normalize_columns(df: DataFrame, norms: np.ndarray) -> DataFrame:
    """Divide every column by its L1 norm; all-zero columns stay zero."""
    scales = F.lit(np.asarray(norms, dtype=float))
    return df.withColumn(
        "features", F.zip_with("features", scales, lambda x, s: F.when(s > 0, x / s).otherwise(0.0))
    )


def column_norms(df: DataFrame, width: int) -> np.ndarray:
    table = column_l1_norms(df).toArrow()
    out = np.zeros(width)
    out[table.column("feature_id").to_numpy()] = table.column("norm").to_numpy()
    return out


def separable_nmf(
    df: DataFrame, rank: int, *, normalize: bool = False, via: str = "gram", driver_cells: int = 20_000_000
) -> SeparableNMF:
    """Choose ``rank`` extreme columns of a non-negative table and weigh the others by them.

    ``via`` "gram" takes C = X'X, "qr" takes C = R'R from a tall-skinny QR. The weights of each column are
    multiplied by its L1 norm, unless ``normalize`` divided the columns first. Beyond ``driver_cells`` cells C
    stays in Spark as tiles and rows; R would be as large as C, so this size has no "qr" route and asking for it raises.
    """
    if via not in ("gram", "qr"):
        raise ValueError(f"unknown route {via!r}")
    width = feature_width(df)
    if width * width > driver_cells:
        if via == "qr":
            raise TooLarge(f"R of {width} columns has more than {driver_cells} cells; use via='gram'")
        norms = column_norms(df, width)
        rows = gram_rows(normalize_columns(df, norms) if normalize else df).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            columns, h = choose_columns_wide(rows, width, rank)
        finally:
            rows.unpersist()
    else:
        if via == "qr":
            norms = column_norms(df, width)
            r = r_matrix(df)
            c = r.T @ r
        else:
            c, norms = gram_and_norms(df, max_cells=driver_cells)
        if normalize:
            scale = np.where(norms > 0, 1.0 / np.where(norms > 0, norms, 1.0), 0.0)
            c = c * scale[:, None] * scale[None, :]
        columns, h = choose_columns(c, rank)
    if not normalize:
        h = h * norms[None, :]
    return SeparableNMF(columns, h, norms, normalize)

