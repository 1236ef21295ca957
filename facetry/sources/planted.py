"""Tables with a known factorisation, attached to any table of row keys.

Every draw is a function of (row_id, slot, seed), so a generated table can be re-read, split or
retried without changing, and it grows with the keys it is given.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import counter
from ..operators.blocks import lists, vector

PLANTED = "row_id bigint, group_id int, features array<double>, h array<double>, label int"


def group_sizes(groups: int, per_group: int, proportion: float | None = None) -> list[int]:
    """Rows per group: equal, or group 0 gets about ``proportion`` and the rest are equal, rounded up."""
    if proportion is None:
        return [per_group] * groups
    if not 0 < proportion < 1:
        raise ValueError("proportion must lie between 0 and 1")
    if groups < 2:
        raise ValueError("a proportion needs two groups or more")
    total = per_group * groups
    rest = math.ceil(total * (1 - proportion) / (groups - 1))
    if rest * (groups - 1) > total:
        raise ValueError(f"{total} rows are too few to give group 0 a share of {proportion} and the other {groups - 1} groups one size")
    return [total - rest * (groups - 1)] + [rest] * (groups - 1)


def grouped_keys(spark: SparkSession, sizes: Sequence[int]) -> DataFrame:
    """``row_id, group_id`` for groups of the given sizes, numbered consecutively."""
    ends = np.cumsum(sizes)
    keys = spark.range(int(ends[-1])).select(F.col("id").alias("row_id"))
    passed = F.filter(F.lit(ends.astype(np.int64)), lambda end: end <= F.col("row_id"))
    return keys.withColumn("group_id", F.size(passed).cast("int"))


def normal_basis(width: int, rank: int, scale: float = 2.0, seed: int = 0) -> np.ndarray:
    """W with independent N(0, scale) cells (``scale`` is the standard deviation)."""
    return scale * counter.normal(np.arange(width)[:, None], np.arange(rank)[None, :], seed)


def banded_basis(length: int, rank: int, overlap: int, height: float = 1.0) -> np.ndarray:
    """Column k holds ``height`` on ``length`` rows; neighbouring columns share ``overlap`` rows."""
    basis = np.zeros((length * rank - (rank - 1) * overlap, rank))
    for k in range(rank):
        start = k * (length - overlap)
        basis[start : start + length, k] = height
    return basis


def bernoulli_weights(rows: np.ndarray, rank: int, p: float, seed: int) -> np.ndarray:
    """1[u < p], an all-zero row gets its last entry, rows divided by their sum."""
    h = (counter.uniform(np.asarray(rows)[:, None], np.arange(rank)[None, :], seed) < p).astype(float)
    h[h.sum(axis=1) == 0, -1] = 1.0
    return h / h.sum(axis=1, keepdims=True)


def planted(
    keys: DataFrame,
    basis: np.ndarray,
    *,
    weights: str = "dirichlet",
    alpha: float | Sequence[float] = 0.1,
    p: float = 0.5,
    sigmas: Sequence[float] | None = None,
    seed: int = 0,
) -> DataFrame:
    """x = W h (+ sigma_c times N(0,1)) for each key; the true h and its argmax label come along.

    ``weights`` is "dirichlet" (with ``alpha``) or "bernoulli" (with ``p``). ``sigmas`` holds one
    standard deviation per group; without it there is no noise.
    """
    if weights not in ("dirichlet", "bernoulli"):
        raise ValueError(f"unknown weights {weights!r}")
    basis = np.asarray(basis, dtype=float)
    width, rank = basis.shape
    shape = np.broadcast_to(np.asarray(alpha, dtype=float), (rank,)).copy()
    sds = None if sigmas is None else np.asarray(sigmas, dtype=float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, groups = vector(batch, "row_id"), vector(batch, "group_id")
            if sds is not None and len(groups) and not 0 <= int(groups.min()) <= int(groups.max()) < len(sds):
                raise ValueError(f"group_id must lie in 0..{len(sds) - 1}, one for each sigma")
            if weights == "dirichlet":
                h = counter.dirichlet(ids, shape, seed)
            else:
                h = bernoulli_weights(ids, rank, p, seed)
            x = h @ basis.T
            if sds is not None:
                x += sds[groups][:, None] * counter.normal(ids[:, None], np.arange(width)[None, :], seed + 1)
            labels = pa.array(h.argmax(axis=1).astype(np.int32) + np.int32(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id"), batch.column("group_id"), lists(x), lists(h), labels],
                names=["row_id", "group_id", "features", "h", "label"],
            )

    return keys.select(F.col("row_id").cast("bigint"), F.col("group_id").cast("int")).mapInArrow(run, PLANTED)


def random_matrix(keys: DataFrame, width: int, seed: int = 0) -> DataFrame:
    """U(0,1) cells for every key; no key is dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = counter.uniform(vector(batch, "row_id")[:, None], np.arange(width)[None, :], seed)
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), lists(cells)], names=["row_id", "features"])

    return keys.select(F.col("row_id").cast("bigint")).mapInArrow(run, "row_id bigint, features array<double>")
