"""QR of tables too wide for one R: panels of columns, block Gram-Schmidt between them, tall-skinny QR within.

Q takes the place of the table's columns panel by panel; R is written panel by panel and is never whole in one process. Each panel is freed twice
from the panels before it, and its own QR is made twice, which keeps Q orthogonal to rounding for any full-rank table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_scratch
from .blocks import check_cells, dense, lists, replace_column
from .group_stats import PARTIAL, array_sums, partial_matrix
from .tsqr import augmented, r_matrix

PANEL_CELLS = 4_000_000  # cells of R in one panel of columns
SOLUTION_CELLS = 20_000_000


@dataclass
class WideQR:
    """``q``: the table with rows of Q in place of its features. ``r``: blocks ``panel, first, cells``, rows from ``first`` on of a panel of columns."""

    q: DataFrame
    r: DataFrame
    width: int
    panel: int

    def r_rows(self) -> DataFrame:
        """R as rows ``i, features``, zero below its diagonal."""
        one = F.posexplode(F.transform(F.sequence(F.lit(0), F.col("height") - 1), lambda k: F.slice("cells", k * F.col("columns") + 1, F.col("columns"))))
        sized = self.r.withColumn("columns", F.least(F.lit(self.panel), F.lit(self.width) - F.col("panel") * self.panel))
        rows = sized.withColumn("height", (F.size("cells") / F.col("columns")).cast("int")).select("panel", "first", one.alias("k", "cells"))
        rows = rows.groupBy((F.col("first") + F.col("k")).alias("i")).agg(F.array_sort(F.collect_list(F.struct("panel", "cells"))).alias("parts"))
        right = F.flatten(F.transform("parts", lambda p: p["cells"]))
        return rows.select("i", F.concat(F.array_repeat(F.lit(0.0), F.lit(self.width) - F.size(right)), right).alias("features"))

    def solve(self, right_side: np.ndarray | None = None, targets: int = 0) -> np.ndarray:
        """R b = c by blocks from below; with ``targets`` the last columns of R are the right sides, as in an augmented table."""
        m = self.width - targets
        blocks = {}
        if targets:
            tail = self.r.where(F.col("panel") >= m // self.panel).collect()
            right_side = np.zeros((m, targets))
            for row in tail:
                low = row.panel * self.panel
                columns = min(self.panel, self.width - low)
                cells = np.reshape(row.cells, (-1, columns))
                keep = min(m, row["first"] + len(cells)) - row["first"]
                begin = max(0, m - low)
                if keep > 0:
                    right_side[row["first"] : row["first"] + keep, low + begin - m : low + columns - m] = cells[:keep, begin:]
        check_cells(right_side.size, SOLUTION_CELLS, "the solution")
        b = np.array(right_side, dtype=float)
        for panel in range((m - 1) // self.panel, -1, -1):  # a panel of columns at a time reaches the driver
            low, high = panel * self.panel, min((panel + 1) * self.panel, self.width)
            end = min(high, m)
            blocks = {r["first"]: np.reshape(r.cells, (-1, high - low)) for r in self.r.where(F.col("panel") == panel).collect()}
            column = np.concatenate([blocks[k] for k in sorted(blocks)])[:, : end - low]
            b[low:end] = np.linalg.solve(column[low:end], b[low:end])
            b[:low] -= column[:low] @ b[low:end]
        return b


Steps = Sequence[tuple[str, np.ndarray]]


def _freed(x: np.ndarray, low: int, high: int, steps: Steps) -> np.ndarray:
    """The panel [low, high) after some steps in turn: "less" Q times a matrix, or "times" a matrix."""
    a = x[:, low:high]
    for kind, matrix in steps:
        a = a @ matrix if kind == "times" else a - x[:, :low] @ matrix
    return a


def _projections(df: DataFrame, low: int, high: int, known: Steps) -> np.ndarray:
    """Q'A for the panel [low, high) after the steps known so far, with Q the columns before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((low, high - low))
        for batch in batches:
            if batch.num_rows:
                x = dense(batch)
                total += x[:, :low].T @ _freed(x, low, high, known)
        yield from partial_matrix(total)

    return array_sums(df.select("features").mapInArrow(run, PARTIAL))[0]


def _panel(df: DataFrame, low: int, high: int, known: Steps, whole: bool) -> DataFrame:
    """The panel after the steps known so far: alone, or in its place in the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = dense(batch).copy()
            a = _freed(x, low, high, known)
            if whole:
                x[:, low:high] = a
                yield replace_column(batch, "features", lists(x))
            else:
                yield pa.RecordBatch.from_arrays([lists(a)], names=["features"])

    source = df if whole else df.select("features")
    return source.mapInArrow(run, source.schema)


def wide_qr(df: DataFrame, width: int, panel: int | None = None, panel_cells: int = PANEL_CELLS) -> WideQR:
    """X = QR with a non-negative diagonal of R, for a table (``features`` and other columns) of full column rank and any width.

    A panel holds at most ``panel_cells`` cells of R. For each: two sums Q'A of the size of that panel of R, two tall-skinny QRs of the panel, and the table is
    written with the panel's Q in its place to the scratch folder. Rows pass through maps only.
    """
    panel = panel or max(1, min(width, panel_cells // width))
    check_cells(width * panel, max(panel_cells, width), "a panel of R")
    spark, q, parts = df.sparkSession, df, None
    for k, low in enumerate(range(0, width, panel)):
        high = min(low + panel, width)
        known: list[tuple[str, np.ndarray]] = []
        above, here = np.zeros((low, high - low)), np.eye(high - low)
        for _ in range(2):  # the second turn works on columns that are nearly orthonormal already
            if low:
                share = _projections(q, low, high, known)
                above = above + share @ here
                known.append(("less", share))
            r = r_matrix(_panel(q, low, high, known, False))
            known.append(("times", np.linalg.inv(r)))
            here = r @ here
        q = write_scratch(_panel(q, low, high, known, True), "q")
        blocks = [(k, 0, above), (k, low, here)] if low else [(k, low, here)]
        rows = pa.table({"panel": [b[0] for b in blocks], "first": [b[1] for b in blocks], "cells": [np.ravel(b[2]).tolist() for b in blocks]})
        made = write_scratch(spark.createDataFrame(rows, "panel int, first int, cells array<double>"), "r")
        parts = made if parts is None else parts.unionByName(made)
    return WideQR(q, parts, width, panel)


def least_squares_wide(df: DataFrame, targets: Sequence[str], width: int, panel: int | None = None) -> np.ndarray:
    """argmin ||X b - y|| for each target, (width, targets), from the R of [X | Y] in panels."""
    return wide_qr(augmented(df, targets).select("features"), width + len(targets), panel).solve(targets=len(targets))
