"""Tall-skinny QR: R by repeated stacking, Q as a projection of the rows, and least squares through R."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import TooLarge, dense, lists, replace_column

_R_ROWS = "block bigint, i int, features array<double>"


MAX_WIDTH = 4472  # columns; R has at most 20 million cells


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce a task's rows to its R, batch by batch: memory is one batch plus one R."""
    r = None
    for batch in batches:
        if batch.num_rows:
            x = dense(batch)
            if x.shape[1] > MAX_WIDTH:
                raise TooLarge(f"{x.shape[1]} columns; QR here is for tall-skinny tables of at most {MAX_WIDTH}")
            r = np.linalg.qr(x if r is None else np.vstack([r, x]), mode="r")
    if r is not None:
        block = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(r.shape[0], block, dtype=np.int64)),
                pa.array(np.arange(r.shape[0], dtype=np.int32)),
                lists(r),
            ],
            names=["block", "i", "features"],
        )


def _upright(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _fold(batches):
        r = dense(batch)
        k = min(r.shape)
        signs = np.ones(r.shape[0])
        signs[:k] = np.where(np.diagonal(r)[:k] < 0, -1.0, 1.0)
        yield replace_column(batch, "features", lists(r * signs[:, None] + 0.0))


def tsqr_r(df: DataFrame) -> DataFrame:
    """R of X = QR with a non-negative diagonal, as rows ``i, features``.

    Each task reduces its rows to one R; the R's are stacked and reduced again in levels. The first
    level is a plain keyed repartition, which adaptive execution packs by size; a square-root level
    keeps the last task's stack short on large clusters.
    """
    shuffles = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    level = df.select("features").mapInArrow(_fold, _R_ROWS).repartition("block").mapInArrow(_fold, _R_ROWS)
    if shuffles > 64:
        level = level.repartition(math.isqrt(shuffles), "block").mapInArrow(_fold, _R_ROWS)
    return level.repartition(1).mapInArrow(_upright, _R_ROWS).select("i", "features")


def r_matrix(df: DataFrame) -> np.ndarray:
    """R on the driver; its width is checked in the tasks."""
    table = tsqr_r(df).toArrow().combine_chunks()
    return dense(table.to_batches()[0])[np.argsort(table.column("i").to_numpy())]


def thin_q(df: DataFrame, r: np.ndarray) -> DataFrame:
    """Q = X R^-1 row by row: ``features`` becomes the row of Q. Needs full column rank."""
    rt = np.asarray(r, dtype=float).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield replace_column(batch, "features", lists(np.linalg.solve(rt, dense(batch).T).T))

    return df.mapInArrow(run, df.schema)


def mllib_r(df: DataFrame) -> np.ndarray:
    """R from the built-in RowMatrix, for comparison; signs are made the same."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils

    vectors = df.select(array_to_vector("features").alias("v"))
    rows = MLUtils.convertVectorColumnsFromML(vectors, "v")
    r = RowMatrix(rows).tallSkinnyQR(computeQ=False).R.toArray()
    return r * np.where(np.diagonal(r) < 0, -1.0, 1.0)[:, None]


def augmented(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Rows ``[features | targets]``, so that one pass serves all moments of both."""
    return df.withColumn("features", F.concat("features", F.array(*[F.col(t).cast("double") for t in targets])))


def least_squares_qr(df: DataFrame, targets: Sequence[str]) -> np.ndarray:
    """argmin ||X b - y|| for each target, from the R of [X | Y]; shape (width, targets)."""
    r = r_matrix(augmented(df, targets))
    m = r.shape[1] - len(targets)
    return np.linalg.solve(r[:m, :m], r[:m, m:])
