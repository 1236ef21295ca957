"""Cell-wise, row-wise and row-key functions on array columns.

Everything here is a Column expression: it stays on the JVM side, composes with
``select``/``withColumn`` and lets Catalyst prune and push as usual.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_ARITHMETIC = {"+": operator.add, "-": operator.sub, "*": operator.mul, "/": operator.truediv}


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def map_cells(features: str | Column, fn: Callable[[Column], Column]) -> Column:
    """Apply a Column lambda to every cell of an array column."""
    return F.transform(_col(features), fn)


def scalar_op(features: str | Column, op: str, value: float) -> Column:
    """``cell op value`` for op in + - * /."""
    return map_cells(features, lambda x: _ARITHMETIC[op](x, F.lit(float(value))))


def power(features: str | Column, p: float) -> Column:
    return map_cells(features, lambda x: F.pow(x, F.lit(float(p))))


def soft_threshold(features: str | Column, lam: float) -> Column:
    """sign(x) * max(|x| - lam, 0) per cell; zeros come out as +0.0."""
    return map_cells(
        features,
        lambda x: F.signum(x) * F.greatest(F.abs(x) - F.lit(float(lam)), F.lit(0.0)) + F.lit(0.0),
    )


def clamp_below(features: str | Column, eps: float = 1e-5) -> Column:
    return map_cells(features, lambda x: F.greatest(x, F.lit(float(eps))))


def pick(features: str | Column, indices: Sequence[int]) -> Column:
    """The cells at the given 0-based positions, in the given order."""
    c = _col(features)
    return F.array(*[F.get(c, F.lit(int(i))) for i in indices])


def column_slice(features: str | Column, start: int, stop: int) -> Column:
    """Cells start .. stop-1 (0-based, end exclusive)."""
    return F.slice(_col(features), start + 1, stop - start)


def zip_op(left: Column, right: Column, op: str) -> Column:
    return F.zip_with(left, right, _ARITHMETIC[op])


def fold(features: str | Column, zero: float, fn: Callable[[Column, Column], Column]) -> Column:
    """Fold one row's cells with a Column lambda ``fn(acc, x)``."""
    return F.aggregate(_col(features), F.lit(float(zero)), fn)


def row_sum(features: str | Column) -> Column:
    return fold(features, 0.0, lambda a, x: a + x)


def row_product(features: str | Column) -> Column:
    return fold(features, 1.0, lambda a, x: a * x)


def row_sumsq(features: str | Column) -> Column:
    return fold(features, 0.0, lambda a, x: a + x * x)


def row_abs_sum(features: str | Column) -> Column:
    return fold(features, 0.0, lambda a, x: a + F.abs(x))


def row_min(features: str | Column) -> Column:
    return F.array_min(_col(features))


def row_max(features: str | Column) -> Column:
    return F.array_max(_col(features))


def positive_part_norm(features: str | Column) -> Column:
    """Euclidean norm of max(x, 0)."""
    return F.sqrt(fold(features, 0.0, lambda a, x: a + F.pow(F.greatest(x, F.lit(0.0)), F.lit(2.0))))


def argmax(features: str | Column, base: int = 1) -> Column:
    """Position of the first maximum; base 1 for class labels, base 0 for column indices."""
    c = _col(features)
    return (F.array_position(c, F.array_max(c)) - F.lit(1 - base)).cast("int")


def row_uniform(row_id: str | Column, seed: int = 0) -> Column:
    """A uniform number in [0, 1) that depends on the row's key and the seed only.

    Taken from md5, so that any engine can reproduce it and no partitioning changes it.
    """
    digest = F.md5(F.concat_ws(":", _col(row_id).cast("string"), F.lit(str(int(seed)))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
