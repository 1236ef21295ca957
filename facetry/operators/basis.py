"""Updates of the shared basis from group statistics.

For weights omega_c summing to one the objective is
F(W) = 1/2 sum_c omega_c ||X_c - W H_c||^2 + (lam / C) ||W||_1.
Given the rank x rank matrices G_c it splits by feature: row f of W needs only row f of every P_c.
So an update takes any block of features, on the driver for small statistics or as a Spark job
over blocks of features otherwise, with the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import check_cells
from .group_stats import CROSS, GroupState


# Inner steps by solver, and CEASE's steps within a group.
INNER_STEPS = {"agd": 35, "ista": 35, "admm": 10, "cease": 5}
LOCAL_STEPS = 20
LEAST_STEPS = 5
BASIS, GAP, MOVE = 0, 1, 2  # parts of a block's result


def soft(a: np.ndarray, t: float | np.ndarray) -> np.ndarray:
    return np.sign(a) * np.maximum(np.abs(a) - t, 0.0)


def top_eigenvalue(symmetric: np.ndarray) -> np.ndarray:
    """Largest eigenvalue of a symmetric matrix, or of each in a stack."""
    return np.linalg.eigvalsh(symmetric)[..., -1]


def weight_spectrum(grams: np.ndarray) -> tuple[float, float, float]:
    """Smallest and largest eigenvalue and condition number of the summed Gram matrices."""
    values = np.linalg.eigvalsh(grams.sum(axis=0) if grams.ndim == 3 else grams)
    return float(values[0]), float(values[-1]), float(values[-1] / values[0])


def precision_weights(variances: np.ndarray) -> np.ndarray:
    """omega_c = (1/var_c) / sum(1/var)."""
    precision = 1.0 / np.asarray(variances, dtype=float)
    return precision / precision.sum()


def fista(
    gradient: Callable[[np.ndarray], np.ndarray],
    start: np.ndarray,
    lipschitz: float | np.ndarray,
    lam: float,
    max_iter: int,
    momentum: str = "damped",
) -> np.ndarray:
    """Proximal gradient with an L1 term.

    ``momentum``: "none" (ISTA), "standard" (t' = (1 + sqrt(1 + 4t^2)) / 2), or "damped"
    (t' = 1/2 + sqrt(1 + 4t^2), whose factor tends to 1/2 and suits strongly convex problems).
    The gradient is taken at the extrapolated point.
    """
    w = start
    for w in fista_steps(gradient, start, lipschitz, lam, max_iter, momentum):
        pass
    return w


def fista_steps(
    gradient: Callable[[np.ndarray], np.ndarray],
    start: np.ndarray,
    lipschitz: float | np.ndarray,
    lam: float,
    max_iter: int,
    momentum: str = "damped",
) -> Iterator[np.ndarray]:
    """The iterates of ``fista``."""
    w, y, t = start, start, 1.0
    for _ in range(max_iter):
        new = soft(y - gradient(y) / lipschitz, lam / lipschitz)
        if momentum == "none":
            y = new
        else:
            t_new = 0.5 + np.sqrt(1 + 4 * t * t) if momentum == "damped" else 0.5 * (1 + np.sqrt(1 + 4 * t * t))
            y = new + (new - w) * ((t - 1) / t_new)
            t = t_new
        w = new
        yield w


@dataclass(frozen=True)
class BasisStep:
    """One basis update. ``solver``: agd, ista, admm, cease; ``hyper``: ADMM's rho, CEASE's gamma.

    Differences from textbook or earlier forms, on purpose: ADMM is the scaled form with the proximal
    centre at the current consensus; CEASE returns the averaged basis, corrects its surrogate by
    (own gradient - global gradient) and thresholds by lam / C; stopping never compares an iterate with itself.

    ADMM ends once the basis moves by less than ``inner_tol`` times the norm of the start, after LEAST_STEPS steps at the
    earliest (0: all steps); the other solvers have a fixed number of inner steps.
    """

    solver: str
    lam: float
    omega: np.ndarray
    hyper: float = 5.0
    max_iter: int | None = None
    momentum: str = "damped"
    local_iter: int = LOCAL_STEPS
    inner_tol: float = 0.0

    def steps(self) -> int:
        if self.max_iter is not None:
            return self.max_iter
        return INNER_STEPS[self.solver]

    def path(self, cross: np.ndarray, grams: np.ndarray, start: np.ndarray) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """(W, copies) after 1, 2, ... inner steps."""
        return list(self.iterates(cross, grams, start))

    def iterates(self, cross: np.ndarray, grams: np.ndarray, start: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """(W, copies) after each inner step, up to the one that stops."""
        if self.solver in ("agd", "ista"):
            yield from ((w, None) for w in self._gradient(cross, grams, start))
        elif self.solver == "admm":
            yield from self._admm(cross, grams, start)
        elif self.solver == "cease":
            yield from self._cease(cross, grams, start)
        else:
            raise ValueError(f"unknown solver {self.solver!r}")

    def solve(self, cross: np.ndarray, grams: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """(W, per-group copies) for a block of features: cross (f, C, r), grams (C, r, r), start (f, r)."""
        found: tuple[np.ndarray, np.ndarray | None] = (start, None)
        for found in self.iterates(cross, grams, start):
            pass
        return found

    def stops(self, step: int, move: float, size: float) -> bool:
        return self.inner_tol > 0 and step >= LEAST_STEPS and move < self.inner_tol * size

    def _gradient(self, cross: np.ndarray, grams: np.ndarray, start: np.ndarray) -> Iterator[np.ndarray]:
        g = np.tensordot(self.omega, grams, axes=1)
        p = np.einsum("c,fcr->fr", self.omega, cross)
        lam = self.lam / len(self.omega)
        momentum = "none" if self.solver == "ista" else self.momentum
        return fista_steps(lambda w: w @ g - p, start, float(top_eigenvalue(g)), lam, self.steps(), momentum)

    def _admm(self, cross: np.ndarray, grams: np.ndarray, start: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        rho, c, rank = self.hyper, len(self.omega), start.shape[1]
        inverse = np.linalg.inv(np.eye(rank) + grams / rho)
        w = start
        copies = np.broadcast_to(w[:, None, :], cross.shape)
        dual = np.zeros_like(cross)
        for step in range(1, self.steps() + 1):
            copies = np.einsum("fcr,crs->fcs", cross / rho + w[:, None, :] - dual, inverse)
            before, w = w, np.einsum("c,fcr->fr", self.omega, copies + dual)
            if self.lam:
                w = soft(w, self.lam / (c * rho))
            dual = dual + copies - w[:, None, :]
            yield w, copies
            if self.stops(step, float(np.linalg.norm(w - before)), float(np.linalg.norm(start))):
                return

    def _cease(self, cross: np.ndarray, grams: np.ndarray, start: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        gamma, c, rank = self.hyper, len(self.omega), start.shape[1]
        regular = grams + gamma * np.eye(rank)
        inverse = np.linalg.inv(regular)
        bound = top_eigenvalue(regular)[None, :, None]
        w = start
        copies = np.broadcast_to(w[:, None, :], cross.shape)
        for _ in range(self.steps()):
            own = np.einsum("fr,crs->fcs", w, grams) - cross
            shared = np.einsum("c,fcr->fr", self.omega, own)[:, None, :]
            if self.lam:
                right = cross + gamma * w[:, None, :] + own - shared
                begin = np.broadcast_to(w[:, None, :], cross.shape)

                def slope(v: np.ndarray, right: np.ndarray = right) -> np.ndarray:
                    return np.einsum("fcr,crs->fcs", v, regular) - right

                copies = fista(slope, begin, bound, self.lam / c, self.local_iter, self.momentum)
            else:
                copies = w[:, None, :] - np.einsum("fcr,crs->fcs", np.broadcast_to(shared, cross.shape), inverse)
            w = np.einsum("c,fcr->fr", self.omega, copies)
            yield w, copies


def update_wide_basis(
    stats: DataFrame,
    state: GroupState,
    step: BasisStep,
    start: np.ndarray,
    rescale: np.ndarray | None = None,
    block_cells: int = 2_000_000,
) -> tuple[np.ndarray, float]:
    """(W, violation) of the same update as a Spark job over blocks of features, for statistics too large for the driver.

    A block holds (features in the block) x groups x rank cells, at most about ``block_cells``; the
    statistics are already summed, so every block has the same size and none is hot. ``rescale`` is
    the (C, r) scale that ``state`` has been divided by, if any.

    With a stop rule every block also returns how far each of its steps moved; where all blocks together would have stopped early, a
    second job runs them for that number of steps.
    """
    c, rank = state.sum_h.shape
    width = start.shape[0]
    per_block = max(1, block_cells // (c * rank))
    groups, grams = state.groups, state.gram

    fixed = replace(step, inner_tol=0.0)

    def run(pdf: pd.DataFrame, step: BasisStep) -> pd.DataFrame:
        low = int(pdf["i"].min()) // per_block * per_block
        high = min(low + per_block, width)
        cross = np.zeros((high - low, c, rank))
        cross[pdf["i"] - low, np.searchsorted(groups, pdf["group_id"]), pdf["j"]] = pdf["value"]
        if rescale is not None:
            cross /= rescale
        w, copies, moves = start[low:high], None, []
        for new, copies in step.iterates(cross, grams, w):  # noqa: B007
            moves.append(float(np.square(new - w).sum()))
            w = new
        f, k = np.indices(w.shape)
        gaps = np.zeros(0) if copies is None else np.square(copies - w[:, None, :]).sum(axis=(0, 2))
        parts = [(BASIS, f + low, k, w), (GAP, np.zeros(len(gaps)), np.arange(len(gaps)), gaps), (MOVE, np.zeros(len(moves)), np.arange(len(moves)), np.array(moves))]
        frames = [pd.DataFrame({"part": part, "i": np.ravel(i), "j": np.ravel(j), "value": np.ravel(v)}) for part, i, j, v in parts]
        return pd.concat(frames).astype({"part": int, "i": int, "j": int, "value": float})

    cross = stats.filter(F.col("kind") == CROSS).select(
        "group_id", "i", "j", "value", F.floor(F.col("i") / per_block).alias("block")
    )
    check_cells(start.size, 20_000_000, "the basis")

    def job(step: BasisStep) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = cross.groupBy("block").applyInPandas(lambda pdf: run(pdf, step), "part int, i int, j int, value double")
        cells = found.groupBy("part", "i", "j").agg(F.sum("value").alias("value")).toArrow()
        part, i, j, v = (cells.column(name).to_numpy() for name in ("part", "i", "j", "value"))
        w, gaps, moves = np.zeros_like(start), np.zeros(c), np.zeros(step.steps())
        w[i[part == BASIS], j[part == BASIS]] = v[part == BASIS]
        gaps[j[part == GAP]] = v[part == GAP]
        moves[j[part == MOVE]] = v[part == MOVE]
        return w, gaps, np.sqrt(moves)

    w, gaps, moves = job(fixed)
    if step.solver == "admm":
        size = float(np.linalg.norm(start))
        enough = next((k for k, move in enumerate(moves, start=1) if step.stops(k, float(move), size)), len(moves))
        if enough < len(moves):
            w, gaps, _ = job(replace(fixed, max_iter=enough))
    return w, float(np.sqrt(gaps).mean())


def pooled_least_squares(state: GroupState) -> np.ndarray:
    """The basis that minimises the summed squared error of all groups, from the moments."""
    return np.linalg.lstsq(state.gram.sum(axis=0), state.cross.sum(axis=1).T, rcond=None)[0].T


def squared_errors(state: GroupState, basis: np.ndarray, centre: np.ndarray | None = None) -> np.ndarray:
    """||X_c - W H_c||^2 per group from moments, for trying out a basis without a pass.

    With ``centre`` the state is that of X - centre H (``weighted_statistics(..., centre=...)``): its squares are residuals added up row by
    row, and what is subtracted from them is of the size of W - centre. Without, large sums are subtracted, which serves noisy data only.
    """
    if state.cross is None:
        raise ValueError("needs the cross statistics on the driver")
    if centre is not None:
        basis = basis - centre
    inner = np.einsum("fr,crs,fs->c", basis, state.gram, basis)
    return np.maximum(state.squares - 2 * np.einsum("fr,fcr->c", basis, state.cross) + inner, 0.0)


def objective(state: GroupState, basis: np.ndarray, lam: float, omega: np.ndarray) -> float:
    """F(W) for the weights whose squared errors ``state`` holds."""
    return float(0.5 * omega @ state.sse + lam / len(omega) * np.abs(basis).sum())


def fit_error(state: GroupState, width: int) -> float:
    """Half the sum over groups of the (unsquared) residual norm per feature."""
    return float(0.5 * np.sqrt(state.sse).sum() / width)


def mean_loss(state: GroupState, basis: np.ndarray, lam: float) -> float:
    """(sum of squared errors + lam ||W||_1) / number of groups."""
    return float((state.sse.sum() + lam * np.abs(basis).sum()) / len(state.n))


def violation(copies: np.ndarray | None, basis: np.ndarray) -> float:
    """Mean Frobenius distance of the groups' copies from the consensus."""
    if copies is None:
        return 0.0
    gaps = copies - basis[:, None, :]
    return float(np.sqrt(np.einsum("fcr,fcr->c", gaps, gaps)).mean())


def distance(basis: np.ndarray, truth: np.ndarray) -> float:
    """Spectral norm of the difference from a known basis."""
    return float(np.linalg.norm(truth - basis, 2))


def estimate_variance(grams: np.ndarray, sigmas: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Theoretical variance of the estimated basis, plain and noise-aware: one entry per column.

    ``sigmas`` are standard deviations. With L_c = (I + G_c / rho)^-1: plain is
    diag sum L G L s^2 / (C rho)^2, aware is diag sum L G L / (s^2 (sum 1/s^2)^2) / rho^2.
    """
    c, rank, _ = grams.shape
    s2 = np.asarray(sigmas, dtype=float) ** 2
    inverse = np.linalg.inv(np.eye(rank) + grams / rho)
    sandwich = np.diagonal(inverse @ grams @ inverse, axis1=1, axis2=2)
    plain = (sandwich * s2[:, None]).sum(axis=0) / (c * rho) ** 2
    aware = (sandwich / s2[:, None]).sum(axis=0) / (1.0 / s2).sum() ** 2 / rho**2
    return plain, aware
