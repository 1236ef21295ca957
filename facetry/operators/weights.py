"""Row weights for a given basis: on the simplex, or merely non-negative.

Each row's weights minimise a convex function of that row alone, so nothing about them is kept
between passes and any task may recompute them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .blocks import dense, lists, vector

# Where the barrier starts, its factor per step, the share of the way to the boundary, the clamp.
BARRIER_START = 2.0
BARRIER_FACTOR = 0.3
STEP_SHARE = 0.995
CLAMP = 1e-5
SYSTEM_CELLS = 1_000_000  # cells of the stacked Newton systems solved at once
CHUNK_ROWS = 8192  # and rows, so that their vectors stay in a core's cache
ELIMINATED = 16  # systems of up to so many unknowns are eliminated for all rows together, larger ones solved by LAPACK row by row
NEAR_ENOUGH = 1e-6  # relative residual that a row may be left with when the steps run out


class NotConverged(ArithmeticError):
    """Rows whose weights are no minimiser after all steps."""


def _all_converged(h: np.ndarray, open_rows: np.ndarray) -> np.ndarray:
    if open_rows.any():
        raise NotConverged(f"weights of {int(open_rows.sum())} of {len(h)} rows have not converged, first at row {int(np.argmax(open_rows))}")
    return h


def simplex_minimiser(
    b: np.ndarray, q: np.ndarray, alpha: np.ndarray, eps: float = CLAMP, tol: float = 1e-11, max_iter: int = 100
) -> np.ndarray:
    """Rows h minimising h'qh/2 - b'h - sum alpha log h on sum(h) = 1; raises NotConverged if the steps do not suffice.

    Interior-point Newton for a whole block: the slacks are eliminated, leaving one r x r system
    per row. The step stays inside the positive orthant for weights and slacks alike, so the result
    does not depend on the start. The solution is clamped to ``eps`` without renormalising.
    """
    return _all_converged(*simplex_rows(b, q, alpha, eps, tol, max_iter))


def simplex_rows(
    b: np.ndarray, q: np.ndarray, alpha: np.ndarray, eps: float = CLAMP, tol: float = 1e-11, max_iter: int = 100
) -> tuple[np.ndarray, np.ndarray]:
    """``simplex_minimiser``'s rows, and which of them have not converged."""
    n, r = b.shape
    if r == 1:
        return np.ones((n, 1)), np.zeros(n, dtype=bool)
    chunk = max(1, min(CHUNK_ROWS, SYSTEM_CELLS // (r * r)))
    if n > chunk:
        parts = [simplex_rows(b[k : k + chunk], q, alpha, eps, tol, max_iter) for k in range(0, n, chunk)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    out, open_rows = np.empty((n, r)), np.zeros(n, dtype=bool)
    rows = np.arange(n)
    b, least, alpha = np.ascontiguousarray(b.T), alpha.min(), alpha[:, None]  # from here on a column for each row
    h = np.full((r, n), 1.0 / r)
    slope = q.T @ h - b
    mu = slope.min(axis=0) - 1.0
    s = slope - mu
    scale = 1.0 + np.abs(b).max(axis=0)
    barrier = BARRIER_START
    for _ in range(max_iter):
        r_dual = q.T @ h - mu - s - b
        r_sum = h.sum(axis=0) - 1.0
        r_comp = h * s - np.maximum(barrier, alpha)
        if barrier <= least:
            worst = np.maximum(np.abs(r_dual).max(axis=0), np.maximum(np.abs(r_sum), np.abs(r_comp).max(axis=0)))
            done = worst <= tol * scale
            if done.any():
                out[rows[done]] = h[:, done].T
                go = np.flatnonzero(~done)
                rows, mu, scale, r_sum = rows[go], mu[go], scale[go], r_sum[go]
                h, s, b, r_dual, r_comp = (x.take(go, axis=1) for x in (h, s, b, r_dual, r_comp))
                if not rows.size:
                    break
        first, ones = _solve_systems(q, s / h, -r_dual - r_comp / h)
        d_mu = (-r_sum - first.sum(axis=0)) / ones.sum(axis=0)
        d_h = first + d_mu * ones
        d_s = (-r_comp - s * d_h) / h
        with np.errstate(divide="ignore", invalid="ignore"):
            room_h = np.where(d_h < 0, -h / d_h, np.inf).min(axis=0)
            room_s = np.where(d_s < 0, -s / d_s, np.inf).min(axis=0)
        step = np.minimum(1.0, STEP_SHARE * np.minimum(room_h, room_s))
        h = h + step * d_h
        s = s + step * d_s
        mu = mu + step * d_mu
        barrier *= BARRIER_FACTOR
    if rows.size:
        out[rows] = h.T
        left = np.maximum(np.abs(q.T @ h - mu - s - b), np.abs(h * s - np.maximum(barrier, alpha))).max(axis=0)
        open_rows[rows] = np.maximum(left, np.abs(h.sum(axis=0) - 1.0)) > NEAR_ENOUGH * scale
    return np.maximum(out, eps), open_rows


def _solve_systems(q: np.ndarray, added: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every column i, the solutions of q + diag(added[:, i]), symmetric and positive definite, for right[:, i] and for ones."""
    r, n = added.shape
    if r > ELIMINATED:
        systems = np.broadcast_to(q, (n, r, r)).copy()
        systems[:, np.arange(r), np.arange(r)] += added.T
        y = np.linalg.solve(systems, np.stack([right.T, np.ones((n, r))], axis=2))
        return y[:, :, 0].T, y[:, :, 1].T
    lower = [[q[i, j] for j in range(i)] + [q[i, i] + added[i]] for i in range(r)]  # each entry a vector over the columns once it differs among them
    first, ones = right.copy(), np.ones((r, n))
    for k in range(r):
        share = {i: lower[i][k] / lower[k][k] for i in range(k + 1, r)}
        for i in range(k + 1, r):
            for j in range(k + 1, i + 1):
                lower[i][j] = lower[i][j] - share[i] * lower[j][k]
            first[i] -= share[i] * first[k]
            ones[i] -= share[i] * ones[k]
        for i in range(k + 1, r):
            lower[i][k] = share[i]
    for k in range(r - 1, -1, -1):
        first[k] /= lower[k][k]
        ones[k] /= lower[k][k]
        for i in range(k + 1, r):
            first[k] -= lower[i][k] * first[i]
            ones[k] -= lower[i][k] * ones[i]
    return first, ones


def nonnegative_minimiser(b: np.ndarray, q: np.ndarray, max_iter: int = 200) -> np.ndarray:
    """Rows h >= 0 minimising h'qh/2 - b'h, by block principal pivoting; raises NotConverged if the steps do not suffice."""
    return _all_converged(*nonnegative_rows(b, q, max_iter))


def nonnegative_rows(b: np.ndarray, q: np.ndarray, max_iter: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """``nonnegative_minimiser``'s rows, and which of them have not converged (Kim and Park 2011).

    Rows that share a set of free variables share one factorisation. A rank-deficient ``q`` gets a
    tiny ridge, which makes the minimiser unique.
    """
    n, r = b.shape
    values = np.linalg.eigvalsh(q)
    if values[0] <= 1e-12 * max(values[-1], 1e-300):
        q = q + 1e-10 * max(values[-1], 1e-300) * np.eye(r)
    free = np.zeros((n, r), dtype=bool)
    h = np.zeros((n, r))
    grad = -b
    tol = 1e-12 * (1.0 + np.abs(b).max(axis=1, keepdims=True))
    best = np.full(n, r + 1)
    patience = np.full(n, 3)
    for _ in range(max_iter * r):
        wrong = (free & (h < -tol)) | (~free & (grad < -tol))
        count = wrong.sum(axis=1)
        rows = np.flatnonzero(count)
        if not rows.size:
            break
        better = count[rows] < best[rows]
        best[rows[better]] = count[rows[better]]
        patience[rows[better]] = 3
        patience[rows[~better]] -= 1
        single = rows[patience[rows] < 0]
        flips = wrong.copy()
        if single.size:
            last = r - 1 - np.argmax(wrong[single][:, ::-1], axis=1)
            flips[single] = False
            flips[single, last] = True
        free[rows] ^= flips[rows]
        patterns, which = np.unique(free[rows], axis=0, return_inverse=True)
        which = np.ravel(which)
        for k, pattern in enumerate(patterns):
            members = rows[which == k]
            h[members] = 0.0
            on = np.flatnonzero(pattern)
            if on.size:
                h[np.ix_(members, on)] = np.linalg.solve(q[np.ix_(on, on)], b[np.ix_(members, on)].T).T
        grad[rows] = h[rows] @ q - b[rows]
        grad[free] = 0.0
    loose = NEAR_ENOUGH * (1.0 + np.abs(b).max(axis=1, keepdims=True))
    return np.maximum(h, 0.0), ((free & (h < -loose)) | (~free & (grad < -loose))).any(axis=1)


Bases = np.ndarray | Mapping[int | None, np.ndarray]


def weight_kernel(
    bases: Bases, mode: str, alpha: float | np.ndarray, eps: float
) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(groups, X) -> (H, squared residual per row, rows not converged), for one shared basis or one per group."""
    if mode not in ("simplex", "nonnegative"):
        raise ValueError(f"unknown weights {mode!r}")

    def solve(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, b = w.T @ w, x @ w
        if mode == "simplex":
            h, open_rows = simplex_rows(b, q, np.broadcast_to(np.asarray(alpha, dtype=float), (w.shape[1],)), eps)
        else:
            h, open_rows = nonnegative_rows(b, q)
        gap = x - h @ w.T
        return h, np.einsum("ij,ij->i", gap, gap), open_rows

    if isinstance(bases, np.ndarray):
        return lambda groups, x: solve(x, bases)

    def by_group(groups: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = np.empty((x.shape[0], next(iter(bases.values())).shape[1]))  # a basis under None serves all other groups
        sse, open_rows = np.empty(x.shape[0]), np.empty(x.shape[0], dtype=bool)
        order = np.argsort(groups, kind="stable")
        ids, starts = np.unique(groups[order], return_index=True)
        for g, mine in zip(ids.tolist(), np.split(order, starts[1:]), strict=True):
            h[mine], sse[mine], open_rows[mine] = solve(x[mine], bases[g] if g in bases else bases[None])
        return h, sse, open_rows

    return by_group


def row_weights(
    df: DataFrame,
    bases: Bases,
    mode: str = "simplex",
    alpha: float | np.ndarray = 0.1,
    eps: float = CLAMP,
    keep: Sequence[str] = (),
) -> DataFrame:
    """The weight table of a feature table for a given basis; a map without a shuffle.

    The columns named in ``keep`` pass through, so that nothing has to be joined back by key. A row whose weights have
    not converged raises.
    """
    kernel = weight_kernel(bases, mode, alpha, eps)
    carried = [c for c in keep if c not in ("row_id", "group_id")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                h, _, open_rows = kernel(vector(batch, "group_id"), dense(batch))
                if open_rows.any():
                    raise NotConverged(f"weights have not converged at row_id {batch.column('row_id')[int(np.argmax(open_rows))]}")
                columns = [batch.column(c) for c in ("row_id", "group_id", *carried)]
                yield pa.RecordBatch.from_arrays([*columns, lists(h)], names=["row_id", "group_id", *carried, "h"])

    rows = df.select("row_id", "group_id", *carried, *([] if "features" in carried else ["features"]))
    fields = [f for c in ("row_id", "group_id", *carried) for f in rows.select(c).schema]
    return rows.mapInArrow(run, StructType([*fields, StructField("h", ArrayType(DoubleType()))]))


def nonnegative_least_squares(rhs: DataFrame, ata: np.ndarray, column: str = "atb") -> DataFrame:
    """``row_id, h``: argmin_{h>=0} of h'(AtA)h/2 - h'(Atb) for a table of right-hand sides."""
    q = np.asarray(ata, dtype=float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                h = nonnegative_minimiser(dense(batch, column), q)
                yield pa.RecordBatch.from_arrays([batch.column("row_id"), lists(h)], names=["row_id", "h"])

    return rhs.select("row_id", column).mapInArrow(run, "row_id bigint, h array<double>")
