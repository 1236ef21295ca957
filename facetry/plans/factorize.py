"""Alternating fit of X_c ~ W H_c with one sparse basis W shared by all groups.

Every outer step is one pass over the rows: weights are solved and reduced to group statistics in
the same task, then the basis is updated from the statistics alone. No weights are stored between
steps, so a lost executor costs a recomputation of its tasks and nothing else.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import counter
from ..functions.arrays import argmax
from ..operators import basis as B
from ..operators import keyed_groups as K
from ..operators.blocks import block_facts, check_cells, dense, gather_small, pack_blocks, small_table, unpack_blocks, unpack_drawn
from ..operators.group_stats import (
    GroupState,
    group_ids,
    noise_variances,
    pooled_state,
    read_pooled,
    read_stacked,
    read_state,
    read_whole_state,
    rescale_groups,
    solved_partials,
    solved_statistics,
    stacked_statistics,
    weighted_statistics,
)
from ..operators.kmeans import kmeans
from ..operators.weights import row_weights
from ..sources.tables import basis_table, check_width, feature_width

HISTORY = (
    "run int, step int, objective double, penalised double, fit_error double, mean_loss double, "
    "violation double, unconverged bigint, seconds double"
)
BASIS_CELLS = 20_000_000
DRIVER_CELLS = 4_000_000


def initial_basis(
    df: DataFrame, rank: int, method: str = "random_rows", seed: int = 0, fraction: float = 0.02, rows_per_centre: int = 15
) -> np.ndarray:
    """Starting basis (width x rank).

    random_rows: ``rank`` rows drawn without replacement. kmeans: centres of K-Means (100 iterations) on a sample: the rows that draw less
    than ``fraction``, or the ``rows_per_centre`` x rank lowest draws where those are expected to be more.
    normal: independent N(0,1) cells. Draws are ``counter.uniform`` of the row key.
    """
    if method == "random_rows":
        return _columns_of(_drawn(df, seed).orderBy("draw", "row_id").limit(rank), rank)
    if method == "kmeans":
        drawn, rows = _drawn(df, seed), df.count()
        if fraction * rows > rows_per_centre * rank:
            return _centres(drawn.filter(F.col("draw") < fraction), rank, seed)
        return _centres(drawn.orderBy("draw", "row_id").limit(rows_per_centre * rank), rank, seed)
    if method == "normal":
        return _normal_start(feature_width(df), rank, seed)
    raise ValueError(f"unknown initial basis {method!r}")


def _initial_basis_of_blocks(
    blocks: DataFrame, rows: int, width: int, rank: int, method: str, seed: int, fraction: float = 0.02, rows_per_centre: int = 15
) -> np.ndarray:
    """``initial_basis`` from packed blocks, without another look at the source; the same rows are drawn."""
    if method == "random_rows":
        lowest = unpack_drawn(blocks, seed, per_block=rank).orderBy("draw", "row_id").limit(rank)
        return _columns_of(lowest, rank)
    if method == "kmeans":
        few = rows_per_centre * rank
        if fraction * rows > few:
            return _centres(unpack_drawn(blocks, seed, fraction), rank, seed)
        return _centres(unpack_drawn(blocks, seed, per_block=few).orderBy("draw", "row_id").limit(few), rank, seed)
    if method == "normal":
        return _normal_start(width, rank, seed)
    raise ValueError(f"unknown initial basis {method!r}")


def _columns_of(rows: DataFrame, rank: int) -> np.ndarray:
    found = rows.select("row_id", "features").toArrow().combine_chunks()
    if found.num_rows < rank:
        raise ValueError(f"the table has fewer than {rank} rows")
    return dense(found.to_batches()[0]).T.copy()


def _drawn(df: DataFrame, seed: int) -> DataFrame:
    """``draw, row_id, features``, the same draws as of packed blocks."""

    @F.arrow_udf("double")
    def draw(keys: pa.Array) -> pa.Array:
        return pa.array(counter.uniform(keys.to_numpy(zero_copy_only=False), 0, seed))

    return df.select(draw("row_id").alias("draw"), "row_id", "features")


def _centres(sample: DataFrame, rank: int, seed: int) -> np.ndarray:
    centres = kmeans(sample, rank, seed)
    if len(centres) < rank:
        raise ValueError(f"only {len(centres)} distinct centres for rank {rank}")
    return centres.T.copy()


def _normal_start(width: int, rank: int, seed: int) -> np.ndarray:
    return counter.normal(np.arange(width)[:, None], np.arange(rank)[None, :], seed)


@dataclass
class Factorization:
    """A fitted basis and how it was reached."""

    basis: np.ndarray
    groups: np.ndarray
    variances: np.ndarray
    mode: str
    alpha: float | Sequence[float]
    eps: float
    copies: dict[int, np.ndarray] | None = None
    history: list[tuple] = field(default_factory=list)
    copies_table: DataFrame | None = None  # of groups whose copies are too many for the driver, see keyed_groups.COPIES

    def weights(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """``row_id, group_id, h`` for any feature table of the same width, with columns to keep; unseen groups use the shared basis."""
        if self.copies_table is not None:
            return K.own_basis_weights(df, self.copies_table, self.basis, self.mode, self.alpha, self.eps, keep)
        bases = {**self.copies, None: self.basis} if self.copies else self.basis
        return row_weights(df, bases, self.mode, self.alpha, self.eps, keep)

    def labels(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """``row_id, pred_label``: 1-based position of the largest weight; columns to keep come between."""
        return self.weights(df, keep).select("row_id", *keep, argmax("h").alias("pred_label"))

    def basis_table(self, spark: SparkSession) -> DataFrame:
        return basis_table(spark, self.basis)

    def variance_table(self, spark: SparkSession) -> DataFrame:
        rows = [(int(g), float(v)) for g, v in zip(self.groups, self.variances)]
        return small_table(spark, rows, "group_id int, variance double")

    def history_table(self, spark: SparkSession) -> DataFrame:
        return small_table(spark, self.history, HISTORY)


def factorize(
    df: DataFrame,
    rank: int,
    *,
    solver: str = "admm",
    lam: float = 0.5,
    alpha: float | Sequence[float] = 0.1,
    hyper: float = 5.0,
    weights: str = "simplex",
    noise_aware: bool | None = None,
    init: str | np.ndarray = "random_rows",
    h_basis: str = "shared",
    normalize: str = "group",
    max_iter: int = 20,
    inner_iter: int | None = None,
    inner_tol: float = 1e-4,
    tol: float = 0.0,
    eps: float = 1e-5,
    seed: int = 0,
    run: int = 0,
    cache: bool = True,
    driver_cells: int = DRIVER_CELLS,
    pool_groups: bool | None = None,
    key_groups: bool | None = None,
) -> Factorization:
    """Fit a feature table (``row_id, group_id, features``), or blocks of one made by ``pack_blocks``.

    solver        agd (accelerated gradient), admm (``hyper`` = rho), cease (``hyper`` = gamma), ista
    weights       "simplex" (Dirichlet prior ``alpha``) or "nonnegative" (rescaled after each step,
                  by group or with one scale, see ``normalize``)
    noise_aware   weigh groups by their precision; by default on for admm and cease with simplex weights
    h_basis       which basis the weights see: "shared", or the "group"'s own copy
    tol           stop once the objective changes by less than this share; 0 runs all steps
    inner_tol     admm's inner steps end once the basis moves by less than this share of the norm it had; 0 runs all steps
    cache         keep the input as packed blocks for the passes: a second copy of the table in executor memory or on executor
                  disks; without it every pass reads the source again
    driver_cells  statistics up to this size are updated on the driver, larger ones as a Spark job, with the same result
    pool_groups   add the groups up in Spark; by default where their rank x rank matrices are too many, for agd with simplex weights
    key_groups    keep the groups' matrices in Spark, a row for each, and update the basis there, with the same result; by default where
                  they are too many for the driver and cannot be pooled, or where h_basis="group" has more copies than ``driver_cells``

    Limits, which raise: 1M groups; 20M cells of the basis, or of all bases of an update with keyed groups (eleven for admm). History counts rows
    whose weights have not converged.

    Pooling serves agd with simplex weights, which needs sums over groups alone and has the same
    optimum as the other two solvers. Without noise_aware it is summed over groups within the tasks already.
    """
    if noise_aware is None:
        noise_aware = weights == "simplex" and solver in ("admm", "cease")
    if inner_tol < 0:
        raise ValueError("inner_tol must not be negative")
    if h_basis not in ("shared", "group"):
        raise ValueError(f"unknown h_basis {h_basis!r}")
    if weights == "nonnegative" and h_basis == "group":
        raise ValueError("non-negative weights are rescaled on the shared basis; use h_basis='shared'")
    if normalize not in ("group", "global"):
        raise ValueError(f"unknown rescaling {normalize!r}")
    given_blocks = "cells" in df.columns
    packed = cache or given_blocks
    parts = None
    if given_blocks:
        table = df
    elif cache:
        table = pack_blocks(df).persist(StorageLevel.MEMORY_AND_DISK)
    else:
        table = df.select("row_id", "group_id", "features")
    try:
        if packed:
            rows, width, groups = block_facts(table)
            reads = gather_small(table, 8 * rows * width)
        else:
            width, groups = feature_width(df), group_ids(table)
            reads = check_width(table, width)
        check_cells(width * rank, BASIS_CELLS, "the basis")
        if not isinstance(init, str):
            w = np.array(init, dtype=float)
        elif packed:
            w = _initial_basis_of_blocks(reads, rows, width, rank, init, seed)
        else:
            w = initial_basis(reads, rank, init, seed)
        if w.shape != (width, rank):
            raise ValueError(f"the starting basis has shape {w.shape}, expected {(width, rank)}")
        local = len(groups) * (width * rank + rank * rank + rank + 4) <= driver_cells
        sums_only = solver in ("agd", "ista") and weights == "simplex"
        pool_early = sums_only and not noise_aware
        many = len(groups) * rank * (rank + 1) > BASIS_CELLS
        pooled = many and sums_only if pool_groups is None else pool_groups
        if pooled and not sums_only:
            raise ValueError("pooled groups need solver='agd' or 'ista' and simplex weights")
        own = h_basis == "group" and solver in ("admm", "cease")
        keyed = (many and not sums_only) or (own and not local) if key_groups is None else key_groups and not (pooled or pool_early)
        local = (local and not pooled) or pool_early
        model = Factorization(w, groups, np.ones(len(groups)), weights, alpha, eps)
        if keyed and own:
            parts = K.part_rows(unpack_blocks(table) if packed else reads, width).persist(StorageLevel.MEMORY_AND_DISK)
        previous = math.inf
        for step in range(1, max_iter + 1):
            began = time.monotonic()
            if keyed:
                if own and model.copies_table is not None:
                    partials = K.own_basis_partials(parts, model.copies_table, w, weights, alpha, eps)
                else:
                    partials = solved_partials(reads, w, weights, alpha, eps)
                stats = K.keyed_groups(partials, width, rank)
            else:
                stats = solved_statistics(reads, model.copies or w, weights, alpha, eps, pool_early)
            if keyed or not local:
                stats = stats.persist(StorageLevel.MEMORY_AND_DISK)
            c = len(groups)
            before, scale, copies, gap = w, None, None, None
            if keyed:
                state, total, mean_scale = K.keyed_state(stats, rank)
                table_of_groups, aware = stats, None
                if weights == "simplex":
                    model.variances = noise_variances(state, width)
                    aware = float((1.0 / model.variances).sum()) if noise_aware else None
                elif normalize == "group":
                    table_of_groups, w = K.rescale_keyed(stats, rank), w * mean_scale[None, :]
                else:
                    one = np.where(total > 0, total * rank / state.n.sum(), 1.0)
                    table_of_groups, w = K.rescale_keyed(stats, rank, one), w * one[None, :]
                omega = B.precision_weights(model.variances) if noise_aware else np.full(c, 1.0 / c)
                value = B.objective(state, before, lam, omega)
                update = B.BasisStep(solver, lam, omega, hyper, inner_iter, inner_tol=inner_tol)
                found = K.update_keyed_basis(table_of_groups, update, w, K.Shares(c, width, aware), want_copies=own)
                w, gap, model.copies_table = found.basis, found.violation, found.copies
            elif pool_early:
                state = read_pooled(stats, groups, width, rank, BASIS_CELLS)
                model.variances = noise_variances(state, width)
                omega = np.full(c, 1.0 / c)
                value = B.objective(state, before, lam, omega)
                w, _ = B.BasisStep(solver, lam / c, np.array([1.0 / c]), hyper, inner_iter).solve(
                    state.cross, state.gram, w
                )
            elif pooled:
                state, omega = pooled_state(stats, width, rank, noise_aware=noise_aware, max_cells=BASIS_CELLS)
                model.variances = noise_variances(state, width)
                value = B.objective(state, before, lam, omega)
                update = B.BasisStep(solver, lam / c, np.ones(1), hyper, inner_iter)
                w, _ = update.solve(state.cross, state.gram, w)
            else:
                state = read_state(stats, groups, width, rank, with_cross=local, max_cells=max(driver_cells, BASIS_CELLS))
                state, scale, w, omega = _prepared(model, state, w, width, weights, normalize, noise_aware)
                value = B.objective(state, before, lam, omega)
                update = B.BasisStep(solver, lam, omega, hyper, inner_iter, inner_tol=inner_tol)
                if local:
                    w, copies = update.solve(state.cross, state.gram, w)
                else:
                    w, gap = B.update_wide_basis(stats, state, update, w, scale)
            if keyed or not local:
                stats.unpersist()
            if h_basis == "group" and copies is not None:
                model.copies = {int(g): copies[:, k, :] for k, g in enumerate(groups)}
            gap = B.violation(copies, w) if gap is None else gap
            model.history.append(_history_row(run, step, value, state, before, lam, alpha, weights, gap, began))
            model.basis = w
            if tol and abs(previous - value) <= tol * abs(previous) and math.isfinite(previous):
                break
            previous = value
        return model
    finally:
        if parts is not None:
            parts.unpersist()
        if cache and not given_blocks:
            table.unpersist()


def _prepared(
    model: Factorization, state: GroupState, w: np.ndarray, width: int, weights: str, normalize: str, noise_aware: bool
) -> tuple[GroupState, np.ndarray | None, np.ndarray, np.ndarray]:
    """(state, scale, basis, weights of groups) before an update: variances for simplex weights, rescaling for non-negative ones."""
    scale = None
    if weights == "simplex":
        model.variances = noise_variances(state, width)
    else:
        state, scale = rescale_groups(state, normalize)
        w = w * scale.mean(axis=0)[None, :]
    c = len(state.groups)
    return state, scale, w, B.precision_weights(model.variances) if noise_aware else np.full(c, 1.0 / c)


def _history_row(
    run: int, step: int, value: float, state: GroupState, basis: np.ndarray, lam: float, alpha: float | Sequence[float], weights: str, gap: float, began: float
) -> tuple:
    """A row of HISTORY for the basis that the state's weights have seen."""
    width, rank = basis.shape
    penalised = 0.5 * state.sse.sum() + lam * np.abs(basis).sum()
    if weights == "simplex":
        penalised -= float(np.broadcast_to(np.asarray(alpha, dtype=float), (rank,)) @ state.logs)
    errors = B.fit_error(state, width), B.mean_loss(state, basis, lam)
    return (run, step, value, float(penalised), *errors, gap, state.unconverged, time.monotonic() - began)


def repeat_fit(df: DataFrame, rank: int, seeds: Iterable[int], **options) -> list[Factorization]:
    """One fit per seed, each from its own start, as ``factorize`` would make it; ``run`` in the histories tells them apart.

    The table is packed once (unless ``cache=False``), and every outer step is one pass for all runs: their bases go along together and their
    statistics come back keyed by run and group. Where those are too many for the driver, or groups are to be pooled or keyed, runs follow each other.
    """
    seeds = list(seeds)
    if "cells" not in df.columns and options.get("cache", True):
        blocks = pack_blocks(df).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return repeat_fit(blocks, rank, seeds, **options)
        finally:
            blocks.unpersist()
    together = None
    if not (options.get("pool_groups") or options.get("key_groups")):
        together = _fit_together(df, rank, seeds, **{k: v for k, v in options.items() if k not in ("cache", "pool_groups", "key_groups")})
    return together or [factorize(df, rank, seed=s, run=k, **options) for k, s in enumerate(seeds, start=1)]


def _fit_together(
    df: DataFrame,
    rank: int,
    seeds: Sequence[int],
    *,
    solver: str = "admm",
    lam: float = 0.5,
    alpha: float | Sequence[float] = 0.1,
    hyper: float = 5.0,
    weights: str = "simplex",
    noise_aware: bool | None = None,
    init: str | np.ndarray = "random_rows",
    h_basis: str = "shared",
    normalize: str = "group",
    max_iter: int = 20,
    inner_iter: int | None = None,
    inner_tol: float = 1e-4,
    tol: float = 0.0,
    eps: float = 1e-5,
    driver_cells: int = DRIVER_CELLS,
) -> list[Factorization] | None:
    """The runs of ``repeat_fit`` step by step together, or None where their statistics do not fit the driver."""
    if noise_aware is None:
        noise_aware = weights == "simplex" and solver in ("admm", "cease")
    wrong = h_basis not in ("shared", "group") or normalize not in ("group", "global") or inner_tol < 0
    if wrong or (weights == "nonnegative" and h_basis == "group") or not seeds:
        return None  # factorize says what is wrong
    packed = "cells" in df.columns
    if packed:
        rows, width, groups = block_facts(df)
        reads = gather_small(df, 8 * rows * width)
    else:
        width, groups = feature_width(df), group_ids(df)
        reads = check_width(df.select("row_id", "group_id", "features"), width)
    c = len(groups)
    if len(seeds) * c * (width * rank + rank * rank + 2 * rank + 5) > driver_cells:
        return None
    models = []
    for s in seeds:
        if not isinstance(init, str):
            w = np.array(init, dtype=float)
        else:
            w = _initial_basis_of_blocks(reads, rows, width, rank, init, s) if packed else initial_basis(reads, rank, init, s)
        if w.shape != (width, rank):
            return None
        models.append(Factorization(w, groups, np.ones(c), weights, alpha, eps))
    going, previous = list(range(len(seeds))), [math.inf] * len(seeds)
    for step in range(1, max_iter + 1):
        began = time.monotonic()
        stats = stacked_statistics(reads, [models[k].copies or models[k].basis for k in going], groups, weights, alpha, eps)
        states = read_stacked(stats, len(going), groups, width, rank, max(driver_cells, BASIS_CELLS))
        for k, state in zip(list(going), states, strict=True):
            model, before = models[k], models[k].basis
            state, _, w, omega = _prepared(model, state, before, width, weights, normalize, noise_aware)
            value = B.objective(state, before, lam, omega)
            w, copies = B.BasisStep(solver, lam, omega, hyper, inner_iter, inner_tol=inner_tol).solve(state.cross, state.gram, w)
            if h_basis == "group" and copies is not None:
                model.copies = {int(g): copies[:, n, :] for n, g in enumerate(groups)}
            model.history.append(_history_row(k + 1, step, value, state, before, lam, alpha, weights, B.violation(copies, w), began))
            model.basis = w
            if tol and abs(previous[k] - value) <= tol * abs(previous[k]) and math.isfinite(previous[k]):
                going.remove(k)
            previous[k] = value
        if not going:
            break
    return models


def best_of(models: Sequence[Factorization]) -> Factorization:
    return min(models, key=lambda m: m.history[-1][2])


def known_weights_state(df: DataFrame) -> tuple[GroupState, int, int]:
    """Statistics of a table whose weights are given in ``h``, from one pass; (state, width, rank)."""
    return read_whole_state(weighted_statistics(df))


def fit_basis(
    df: DataFrame,
    start: np.ndarray,
    *,
    solver: str = "admm",
    lam: float = 0.0,
    hyper: float = 5.0,
    noise_aware: bool = False,
    rounds: int = 1,
    inner_iter: int | None = None,
    truth: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
    """The basis for known weights: two passes over the rows in all, then steps on the statistics.

    Returns (W, group variances, history), the history holding after each inner step
    ``(round, step, mean_loss, violation, distance to truth or None)``. With ``noise_aware`` the
    variances are re-estimated between rounds. The second pass adds up residuals about the least-squares basis of the
    first, so that errors of nearby bases do not cancel where the data have little noise.
    """
    state, width, _ = known_weights_state(df)
    centre = B.pooled_least_squares(state)
    residual, _, _ = read_whole_state(weighted_statistics(df, centre=centre))
    history: list[tuple] = []
    c = len(state.groups)

    def errors(point: np.ndarray) -> np.ndarray:
        return B.squared_errors(residual, point, centre)

    def note(turn: int, step: B.BasisStep, begin: np.ndarray) -> None:
        for k, (point, copies) in enumerate(step.iterates(state.cross, state.gram, begin), start=1):
            loss = (errors(point).sum() + lam * np.abs(point).sum()) / c
            gap = None if truth is None else B.distance(point, truth)
            history.append((turn, k, float(loss), B.violation(copies, point), gap))

    w, variances = alternate(state, width, start, solver, hyper, noise_aware, rounds, inner_iter, lam, note, errors)
    return w, variances, history


def alternate(
    state: GroupState,
    width: int,
    start: np.ndarray,
    solver: str,
    hyper: float,
    noise_aware: bool,
    rounds: int,
    inner_iter: int | None,
    lam: float = 0.0,
    note: Callable[[int, B.BasisStep, np.ndarray], None] | None = None,
    errors: Callable[[np.ndarray], np.ndarray] | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Basis steps on fixed statistics, with the variances re-estimated after each round if noise-aware.

    ``errors`` gives each group's squared error of a basis; the moments of ``state`` if not given.
    """
    errors = errors or (lambda basis: B.squared_errors(state, basis))
    variances = np.ones(len(state.groups))
    w = np.asarray(start, dtype=float)
    for turn in range(1, rounds + 1):
        step = B.BasisStep(solver, lam, B.precision_weights(variances), hyper, inner_iter)
        if note is not None:
            note(turn, step, w)
        w, _ = step.solve(state.cross, state.gram, w)
        if noise_aware:
            variances = (errors(w) + 1.0) / (4.0 + width * state.n)
    return w, variances
