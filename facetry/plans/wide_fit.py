"""The fit of a table with so many features that the basis is a table too.

Rows and basis are cut into blocks of features. A pass has two phases: every block of a row is projected on its block of the basis, and the
projections of a row, rank numbers each, are added up; the row's weights follow from that sum and from W'W, and go back to its blocks, where
they make the cross statistics X'H of a block. Given the rank x rank matrices of the groups the update splits by feature, so each block of the basis is
updated by itself. No process holds more than one block of the basis with its groups' statistics, or a bounded part of the rows of one block.
"""

from __future__ import annotations

import math
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import counter
from ..functions.arrays import argmax
from ..operators import basis as B
from ..operators.blocks import check_cells, dense, lists, vector
from ..operators.group_stats import CROSS, PARTIAL, GroupState, add_arrays, array_sums, group_ids, noise_variances, partial_matrix, ragged
from ..operators.weights import NotConverged, nonnegative_rows, simplex_rows
from ..session import write_scratch

BLOCKS = "row_id bigint, group_id int, first int, features array<double>"
BASIS = "first int, cells array<double>"
SHARES = "row_id bigint, group_id int, b array<double>, squares double"
BLOCK_FEATURES = 100_000
PART_CELLS = 8_000_000  # cells of the rows of one block that a task holds
GROUP_CELLS = 20_000_000  # cells of all groups' rank x rank matrices, and of one block's statistics


def feature_blocks(df: DataFrame, block: int = BLOCK_FEATURES) -> DataFrame:
    """``row_id, group_id, features`` as blocks of features, see BLOCKS; ``first`` is a block's first feature."""
    at = F.sequence(F.lit(0), F.size("features") - 1, F.lit(block))
    cut = F.transform(at, lambda f: F.struct(f.alias("first"), F.slice("features", f + 1, block).alias("features")))
    return df.select("row_id", "group_id", F.explode(cut).alias("b")).select("row_id", "group_id", "b.first", "b.features")


def basis_blocks(spark: SparkSession, basis: np.ndarray, block: int = BLOCK_FEATURES) -> DataFrame:
    """A basis matrix as a table of blocks, see BASIS."""
    rows = pa.table({"first": pa.array(range(0, len(basis), block), pa.int32()), "cells": ragged([basis[k : k + block] for k in range(0, len(basis), block)])})
    return spark.createDataFrame(rows, BASIS)


def drawn_basis(blocks: DataFrame, rank: int, seed: int = 0) -> DataFrame:
    """A starting basis of ``rank`` rows with the lowest draws of their key, block by block: the rows ``factorize`` would draw."""

    @F.arrow_udf("double")
    def draw(keys: pa.Array) -> pa.Array:
        return pa.array(counter.uniform(keys.to_numpy(zero_copy_only=False), 0, seed))

    one = blocks.where("first = 0").select("row_id", draw("row_id").alias("draw"))
    picked = [r.row_id for r in one.orderBy("draw", "row_id").limit(rank).collect()]
    if len(picked) < rank:
        raise ValueError(f"the table has fewer than {rank} rows")
    place = {key: k for k, key in enumerate(picked)}

    def stand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, first, cells in zip(vector(batch, "row_id").tolist(), vector(batch, "first").tolist(), batch.column("features"), strict=True):
                x = cells.values.to_numpy(zero_copy_only=False)
                held.setdefault(first, np.zeros((len(x), rank)))[:, place[key]] = x
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), ragged(list(held.values()))], names=["first", "cells"])

    few = blocks.where(F.col("row_id").isin(picked)).select("row_id", "first", "features")
    return few.repartition("first").mapInArrow(stand, BASIS)


def _laid_out(blocks: DataFrame, part_cells: int) -> tuple[DataFrame, int]:
    """Blocks dealt to (first, part), where a part has about ``part_cells`` cells: all of a block's rows lie in as many tasks as that takes."""
    size = blocks.where("first = 0").agg(F.count("*"), F.max(F.size("features"))).first()
    parts = max(1, math.ceil((size[0] or 0) * (size[1] or 1) / part_cells))
    return blocks.withColumn("part", F.pmod(F.xxhash64("row_id"), F.lit(parts)).cast("int")).repartition("first", "part"), parts


def _nothing(ddl: str) -> pa.Table:
    return to_arrow_schema(StructType.fromDDL(ddl)).empty_table()


def _basis_cells(table: pa.Table, rank: int) -> np.ndarray:
    return table.column("cells").combine_chunks()[0].values.to_numpy(zero_copy_only=False).reshape(-1, rank)


def projections(laid: DataFrame, parts: int, basis: DataFrame, rank: int) -> DataFrame:
    """``row_id, group_id, b, squares``: x'W and x'x of every row, added over its blocks."""
    every = basis.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def run(rows: pa.Table, blocks: pa.Table) -> pa.Table:
        w, out = _basis_cells(blocks, rank), []
        for batch in rows.to_batches():
            if batch.num_rows:
                x = dense(batch)
                columns = [batch.column("row_id"), batch.column("group_id"), lists(x @ w), pa.array(np.einsum("ij,ij->i", x, x))]
                out.append(pa.RecordBatch.from_arrays(columns, names=["row_id", "group_id", "b", "squares"]))
        return pa.Table.from_batches(out) if out else _nothing(SHARES)

    shares = laid.groupBy("first", "part").cogroup(every.groupBy("first", "part")).applyInArrow(run, SHARES)
    sums = [F.sum(F.get("b", F.lit(k))) for k in range(rank)]
    return shares.groupBy("row_id").agg(F.first("group_id").alias("group_id"), F.array(*sums).alias("b"), F.sum("squares").alias("squares"))


def block_weights(projected: DataFrame, gram: np.ndarray, mode: str, alpha: float | Sequence[float], eps: float) -> DataFrame:
    """``row_id, group_id, h, sse, squares, open``: every row's weights from its projection and W'W, and its squared error by the moments."""
    prior = np.broadcast_to(np.asarray(alpha, dtype=float), (len(gram),))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            b = dense(batch, "b")
            h, open_rows = simplex_rows(b, gram, prior, eps) if mode == "simplex" else nonnegative_rows(b, gram)
            squares = vector(batch, "squares")
            sse = np.maximum(squares - 2 * np.einsum("ij,ij->i", b, h) + np.einsum("ij,jk,ik->i", h, gram, h), 0.0)
            columns = [batch.column("row_id"), batch.column("group_id"), lists(h), pa.array(sse), pa.array(squares), pa.array(open_rows)]
            yield pa.RecordBatch.from_arrays(columns, names=["row_id", "group_id", "h", "sse", "squares", "open"])

    return projected.mapInArrow(run, "row_id bigint, group_id int, h array<double>, sse double, squares double, open boolean")


def _group_state(weights: DataFrame, groups: np.ndarray, rank: int) -> GroupState:
    """Everything but P, from the weights: one matrix of (groups x numbers per group), added in two levels."""
    c = len(groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((c, 5 + 2 * rank + rank * rank))
        for batch in batches:
            if not batch.num_rows:
                continue
            h, at = dense(batch, "h"), np.searchsorted(groups, vector(batch, "group_id"))
            logs = np.log(np.maximum(h, 1e-300))
            own = [np.ones(len(h)), vector(batch, "sse"), logs.sum(axis=1), vector(batch, "squares"), vector(batch, "open").astype(float)]
            numbers = np.hstack([np.stack(own, axis=1), h, logs, (h[:, :, None] * h[:, None, :]).reshape(len(h), -1)])
            order = np.argsort(at, kind="stable")
            present, starts = np.unique(at[order], return_index=True)
            total[present] += np.add.reduceat(numbers[order], starts, axis=0)
        yield from partial_matrix(total)

    t = array_sums(weights.mapInArrow(run, PARTIAL))[0]
    logs = t[:, 5 + rank : 5 + 2 * rank].sum(axis=0)
    gram = t[:, 5 + 2 * rank :].reshape(c, rank, rank)
    return GroupState(groups, *t[:, :4].T, t[:, 5 : 5 + rank], gram, None, logs, int(t[:, 4].sum()))


def _cross(laid: DataFrame, parts: int, weights: DataFrame, firsts: Sequence[int], rank: int) -> DataFrame:
    """``group_id, first, cells``: P of every group and block. A row's weights go to each of its blocks; parts are added in two levels."""
    sent = weights.select("row_id", "h", F.pmod(F.xxhash64("row_id"), F.lit(parts)).cast("int").alias("part"))
    sent = sent.withColumn("first", F.explode(F.array(*[F.lit(f) for f in firsts])))

    def run(rows: pa.Table, weights: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _nothing(PARTIAL)
        keys = weights.column("row_id").to_numpy()
        order = np.argsort(keys)
        h = np.concatenate([dense(b, "h") for b in weights.to_batches() if b.num_rows])[order]
        totals: dict[int, np.ndarray] = {}
        first = rows.column("first")[0].as_py()
        for batch in rows.to_batches():
            if not batch.num_rows:
                continue
            x, own = dense(batch), h[np.searchsorted(keys[order], vector(batch, "row_id"))]
            groups = vector(batch, "group_id")
            for g in np.unique(groups).tolist():
                mine = groups == g
                part = x[mine].T @ own[mine]
                totals[g] = totals[g] + part if g in totals else part
        n = len(totals)
        columns = [pa.array(list(totals), pa.int32()), pa.array(np.full(n, CROSS), pa.int8()), pa.array(np.full(n, first), pa.int32()), pa.array(np.full(n, rank), pa.int32())]
        bucket = pa.array(np.full(n, rows.column("part")[0].as_py() % 16), pa.int32())
        return pa.Table.from_arrays([*columns, bucket, ragged(list(totals.values()))], names=["group_id", "kind", "row", "width", "bucket", "cells"])

    partials = laid.groupBy("first", "part").cogroup(sent.groupBy("first", "part")).applyInArrow(run, PARTIAL)
    keys = ["group_id", "kind", "row"]
    for deal in ([*keys, "bucket"], keys):
        partials = partials.repartition(*deal).sortWithinPartitions(*keys).mapInArrow(add_arrays, PARTIAL)
    return partials.select("group_id", F.col("row").alias("first"), "cells")


@dataclass
class WideFactorization:
    """A fitted basis as a table of blocks, and how it was reached."""

    basis: DataFrame
    groups: np.ndarray
    variances: np.ndarray
    rank: int
    mode: str
    alpha: float | Sequence[float]
    eps: float
    part_cells: int
    history: list[tuple] = field(default_factory=list)

    def weights(self, blocks: DataFrame) -> DataFrame:
        """``row_id, group_id, h`` for a table of the same blocks. Rows that have not converged raise."""
        laid, parts = _laid_out(blocks, self.part_cells)
        found = block_weights(projections(laid, parts, self.basis, self.rank), _basis_gram(self.basis, self.rank), self.mode, self.alpha, self.eps)
        lost = F.raise_error(F.concat(F.lit(f"{NotConverged.__name__}: weights have not converged at row_id "), F.col("row_id").cast("string")))
        return found.select("row_id", "group_id", F.when(~F.col("open"), F.col("h")).otherwise(lost.cast("array<double>")).alias("h"))

    def labels(self, blocks: DataFrame) -> DataFrame:
        return self.weights(blocks).select("row_id", argmax("h").alias("pred_label"))

    def basis_rows(self) -> DataFrame:
        """``feature_id, w``, one row per feature."""
        w = F.transform(F.sequence(F.lit(0), (F.size("cells") / self.rank).cast("int") - 1), lambda k: F.slice("cells", k * self.rank + 1, self.rank))
        return self.basis.select("first", F.posexplode(w).alias("k", "w")).select((F.col("first") + F.col("k")).alias("feature_id"), "w")


def _basis_gram(basis: DataFrame, rank: int) -> np.ndarray:
    return _basis_sums(basis, rank)[0]


def _basis_sums(basis: DataFrame, rank: int) -> tuple[np.ndarray, float]:
    """(W'W, sum of absolute cells), added over the blocks of the basis."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rank + 1, rank))
        for batch in batches:
            for cells in batch.column("cells"):
                w = cells.values.to_numpy(zero_copy_only=False).reshape(-1, rank)
                total[:rank] += w.T @ w
                total[rank] += np.abs(w).sum(axis=0)
        yield from partial_matrix(total)

    sums = array_sums(basis.select("cells").mapInArrow(run, PARTIAL))[0]
    return sums[:rank], float(sums[rank].sum())


def update_basis_blocks(
    basis: DataFrame, cross: DataFrame, groups: np.ndarray, grams: np.ndarray, step: B.BasisStep, scale: np.ndarray | None = None
) -> tuple[DataFrame, float]:
    """(new basis, violation): every block updated from its own P, with the stop rule over all blocks together. The new blocks lie in the scratch folder.

    ``scale`` is the (C, r) scale that the groups' weights have been divided by; P is divided here, and the basis multiplied by its mean.
    """
    c, rank = grams.shape[0], grams.shape[1]

    def job(step: B.BasisStep) -> tuple[DataFrame, np.ndarray, np.ndarray, float]:
        def run(stats: pa.Table, blocks: pa.Table) -> pa.Table:
            start = _basis_cells(blocks, rank)
            check_cells(start.size * c, GROUP_CELLS, "one block's statistics; take smaller blocks")
            p = np.zeros((len(start), c, rank))
            for g, cells in zip(stats.column("group_id").to_pylist(), stats.column("cells").combine_chunks(), strict=True):
                p[:, int(np.searchsorted(groups, g))] = cells.values.to_numpy(zero_copy_only=False).reshape(-1, rank)
            if scale is not None:
                p, start = p / scale, start * scale.mean(axis=0)
            w, copies, moves = start, None, []
            for new, copies in step.iterates(p, grams, start):  # noqa: B007
                moves.append(float(np.square(new - w).sum()))
                w = new
            gaps = np.zeros(c) if copies is None else np.square(copies - w[:, None, :]).sum(axis=(0, 2))
            first = blocks.column("first").combine_chunks()
            sizes = pa.array([float(np.square(start).sum())])
            return pa.Table.from_arrays([first, ragged([w]), ragged([gaps]), ragged([np.array(moves)]), sizes], names=["first", "cells", "gaps", "moves", "size"])

        made = cross.groupBy("first").cogroup(basis.groupBy("first")).applyInArrow(run, f"{BASIS}, gaps array<double>, moves array<double>, size double")
        made = write_scratch(made, "basis")
        gaps = made.select(F.posexplode("gaps").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").toArrow().column("v").to_numpy()
        moves = made.select(F.posexplode("moves").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").toArrow().column("v").to_numpy()
        return made.select("first", "cells"), gaps, np.sqrt(moves), math.sqrt(made.agg(F.sum("size")).first()[0])

    fixed = replace(step, inner_tol=0.0)
    w, gaps, moves, size = job(fixed)
    if step.solver == "admm":
        enough = next((k for k, move in enumerate(moves, start=1) if step.stops(k, float(move), size)), len(moves))
        if enough < len(moves):
            w, gaps, _, _ = job(replace(fixed, max_iter=enough))
    return w, float(np.sqrt(gaps).mean())


def factorize_blocks(
    blocks: DataFrame,
    rank: int,
    *,
    solver: str = "admm",
    lam: float = 0.5,
    alpha: float | Sequence[float] = 0.1,
    hyper: float = 5.0,
    weights: str = "simplex",
    noise_aware: bool | None = None,
    init: DataFrame | None = None,
    max_iter: int = 20,
    inner_iter: int | None = None,
    inner_tol: float = 1e-4,
    eps: float = 1e-5,
    seed: int = 0,
    part_cells: int = PART_CELLS,
) -> WideFactorization:
    """Fit a table of feature blocks (``feature_blocks``), for any number of features; options as in ``factorize``, non-negative weights rescaled by group.

    ``init`` is a basis in the same blocks, by default ``rank`` drawn rows. The blocks are kept by the executors for the passes. Squared errors come from
    moments (x'x - 2 b'h + h'W'Wh), which is exact up to rounding of x'x. History is that of ``factorize``.
    """
    if noise_aware is None:
        noise_aware = weights == "simplex" and solver in ("admm", "cease")
    groups = group_ids(blocks)
    c = len(groups)
    check_cells(c * (rank * rank + 2 * rank + 5), GROUP_CELLS, "the groups' matrices")
    laid, parts = _laid_out(blocks, part_cells)
    laid = laid.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        basis = write_scratch((drawn_basis(laid.drop("part"), rank, seed) if init is None else init).select("first", "cells"), "basis")
        sizes = {r["first"]: r.n // rank for r in basis.select("first", F.size("cells").alias("n")).collect()}
        firsts, width = sorted(sizes), sum(sizes.values())
        model = WideFactorization(basis, groups, np.ones(c), rank, weights, alpha, eps, part_cells)
        for step in range(1, max_iter + 1):
            began = time.monotonic()
            gram, size = _basis_sums(model.basis, rank)
            solved = write_scratch(block_weights(projections(laid, parts, model.basis, rank), gram, weights, alpha, eps), "weights")
            state, scale = _group_state(solved, groups, rank), None
            if weights == "simplex":
                model.variances = noise_variances(state, width)
            else:
                scale = state.sum_h * rank / state.n[:, None]
                scale[scale <= 0] = 1.0
                state = replace(state, gram=state.gram / scale[:, :, None] / scale[:, None, :])
            omega = B.precision_weights(model.variances) if noise_aware else np.full(c, 1.0 / c)
            update = B.BasisStep(solver, lam, omega, hyper, inner_iter, inner_tol=inner_tol)
            cross = _cross(laid, parts, solved, firsts, rank)
            model.basis, gap = update_basis_blocks(model.basis, cross, groups, state.gram, update, scale)
            value = float(0.5 * omega @ state.sse + lam / c * size)
            penalised = float(0.5 * state.sse.sum() + lam * size)
            if weights == "simplex":
                penalised -= float(np.broadcast_to(np.asarray(alpha, dtype=float), (rank,)) @ state.logs)
            loss = float((state.sse.sum() + lam * size) / c)
            model.history.append((0, step, value, penalised, B.fit_error(state, width), loss, gap, state.unconverged, time.monotonic() - began))
        return model
    finally:
        laid.unpersist()
