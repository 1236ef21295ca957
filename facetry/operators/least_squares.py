"""Ridge regression of table columns on the features."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from .blocks import small_table
from .group_stats import gram_matrix
from .tsqr import augmented


def ridge(df: DataFrame, targets: Sequence[str], lambdas: Sequence[float] = (0.0,)) -> dict[float, np.ndarray]:
    """argmin ||X b - y||^2 + lambda ||b||^2 for every target and every lambda.

    One pass gives X'X and X'Y for all of them; each lambda is then a width x width solve.
    The result maps lambda to a (width, targets) array.
    """
    moments = gram_matrix(augmented(df, targets))
    m = moments.shape[0] - len(targets)
    return {
        float(lam): np.linalg.solve(moments[:m, :m] + lam * np.eye(m), moments[:m, m:]) for lam in lambdas
    }


def coefficients(spark, solutions: dict[float, np.ndarray], targets: Sequence[str]) -> DataFrame:
    """Solutions as ``lambda, feature_id, target, coefficient``."""
    rows = [
        (lam, i, t, float(b[i, k]))
        for lam, b in solutions.items()
        for i in range(b.shape[0])
        for k, t in enumerate(targets)
    ]
    return small_table(spark, rows, "lambda double, feature_id int, target string, coefficient double")
