"""Ridge regression and extreme eigenvalues from passes X'(XP) alone: no width x width matrix anywhere.

Lanczos' process builds, for every start vector, an orthonormal basis V in which X'X is tridiagonal. Shifted systems (X'X + lambda I) b = X'y share that
basis, so one run serves all lambdas, and a pass over the rows serves all targets at once. Vectors have the width of the table and live on the
driver, checked; every new one is orthogonalised against all before it, twice, so that no eigenvalue appears as a copy of itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import counter
from .blocks import check_cells, dense
from .group_stats import PARTIAL, array_sums, partial_matrix

MAX_CELLS = 20_000_000  # of all Lanczos vectors together
NONE_LEFT = 1e-13  # share of a vector's norm below which nothing new is left of it


class NotSolved(ArithmeticError):
    """The steps allowed do not reach the tolerance."""


def gram_times(df: DataFrame, right: np.ndarray, column: str = "features") -> np.ndarray:
    """X'(X P) in one pass: every task multiplies its rows, and tasks' sums are added in two levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(right.shape)
        for batch in batches:
            if batch.num_rows:
                x = dense(batch, column)
                total += x.T @ (x @ right)
        yield from partial_matrix(total)

    return array_sums(df.select(column).mapInArrow(run, PARTIAL))[0]


def cross_moments(df: DataFrame, targets: Sequence[str], column: str = "features") -> np.ndarray:
    """X'Y, (width, targets), in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                y = np.stack([batch.column(t).to_numpy(zero_copy_only=False).astype(float) for t in targets], axis=1)
                part = dense(batch, column).T @ y
                total = part if total is None else total + part
        if total is not None:
            yield from partial_matrix(total)

    return array_sums(df.select(column, *targets).mapInArrow(run, PARTIAL))[0]


@dataclass
class _Chain:
    """One start vector's Lanczos vectors (rows), diagonal and off-diagonal."""

    size: float
    vectors: list[np.ndarray] = field(default_factory=list)
    diagonal: list[float] = field(default_factory=list)
    beside: list[float] = field(default_factory=list)
    done: bool = False

    def extend(self, image: np.ndarray) -> None:
        """Take in X'X times the last vector."""
        last = self.vectors[-1]
        self.diagonal.append(float(last @ image))
        held = np.array(self.vectors)
        rest = image
        for _ in range(2):
            rest = rest - held.T @ (held @ rest)
        norm = float(np.linalg.norm(rest))
        if norm <= NONE_LEFT * max(float(np.linalg.norm(image)), max(map(abs, self.diagonal))) or len(self.vectors) == len(last):
            norm, self.done = 0.0, True
        self.beside.append(norm)
        if norm:
            self.vectors.append(rest / norm)

    def tridiagonal(self) -> np.ndarray:
        k = len(self.diagonal)
        return np.diag(self.diagonal) + np.diag(self.beside[: k - 1], 1) + np.diag(self.beside[: k - 1], -1)

    def solution(self, shift: float) -> tuple[np.ndarray, float]:
        """(y, size of the residual relative to the start) of (T + shift I) y = |start| e1."""
        k = len(self.diagonal)
        right = np.zeros(k)
        right[0] = self.size
        y = np.linalg.lstsq(self.tridiagonal() + shift * np.eye(k), right, rcond=None)[0]
        return y, abs(self.beside[-1] * y[-1]) / self.size


def lanczos(df: DataFrame, starts: np.ndarray, enough: Callable[[_Chain], bool], max_steps: int, column: str = "features") -> list[_Chain]:
    """A chain for every column of ``starts``; all take their steps in the same passes, and a chain ends once ``enough`` or exhausted."""
    width = starts.shape[0]
    chains = []
    for start in starts.T:
        size = float(np.linalg.norm(start))
        chains.append(_Chain(size, [start / size] if size else [], done=size == 0))
    for step in range(1, max_steps + 1):
        going = [c for c in chains if not c.done]
        if not going:
            return chains
        check_cells(width * sum(len(c.vectors) + 1 for c in chains), MAX_CELLS, "the Lanczos vectors")
        images = gram_times(df, np.stack([c.vectors[-1] for c in going], axis=1), column)
        for chain, image in zip(going, images.T, strict=True):
            chain.extend(image)
            chain.done = chain.done or enough(chain)
    if all(c.done for c in chains):
        return chains
    raise NotSolved(f"not within the tolerance after {max_steps} passes")


def ridge_wide(df: DataFrame, targets: Sequence[str], lambdas: Sequence[float] = (0.0,), tol: float = 1e-10, max_steps: int = 500) -> dict[float, np.ndarray]:
    """argmin ||X b - y||^2 + lambda ||b||^2 for every target and every lambda, like ``ridge``, for any width whose vectors fit the driver.

    One pass for X'Y, then one pass a step for all targets and lambdas together, until the residual of every normal equation is below ``tol`` of
    its right side. Steps are at most the width, and far fewer where lambda bounds the condition. A rank-deficient table with lambda 0 gives a solution of
    least norm. ``NotSolved`` where ``max_steps`` do not suffice.
    """
    right = cross_moments(df, targets)
    chains = lanczos(df, right, lambda c: all(c.solution(lam)[1] <= tol for lam in lambdas), max_steps)
    out = {}
    for lam in lambdas:
        columns = [np.array(c.vectors[: len(c.diagonal)]).T @ c.solution(lam)[0] if c.size else np.zeros(len(right)) for c in chains]
        out[float(lam)] = np.stack(columns, axis=1)
    return out


def extreme_eigenvalues(df: DataFrame, tol: float = 1e-8, max_steps: int = 500, seed: int = 0, column: str = "features") -> tuple[float, float, float]:
    """(smallest, largest eigenvalue of X'X, their quotient) without the Gram matrix: one chain from random cells, one pass a step.

    Ends when both ends of the spectrum have residuals below ``tol`` times themselves, or the basis is whole. The smallest eigenvalue of a badly
    conditioned table takes about as many steps as the table is wide.
    """
    width = len(df.select(column).first()[0])

    def settled(chain: _Chain) -> bool:
        values, vectors = np.linalg.eigh(chain.tridiagonal())
        left = np.abs(chain.beside[-1] * vectors[-1, [0, -1]])
        return bool((left <= tol * np.abs(values[[0, -1]])).all())

    start = counter.normal(np.arange(width)[:, None], np.arange(1)[None, :], seed)
    chain = lanczos(df, start, settled, max_steps, column)[0]
    values = np.linalg.eigvalsh(chain.tridiagonal())
    return float(values[0]), float(values[-1]), float(values[-1] / values[0])
