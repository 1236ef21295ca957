"""Groups as keyed rows: basis updates for more groups than the driver can hold the matrices of.

A row holds one group's statistics for a block of features: counts, squared error, summed weights, G and P. ADMM and CEASE solve every group's
copy of the basis where its row lies and add the copies up, so an inner step is a map and one sum whose size is that of the basis. Copies and
duals are not stored: they are functions of the group's own row and of the few bases found so far, which are sent with each step. So nothing but the
statistics has to survive between steps, and a lost executor costs its tasks alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..session import write_scratch
from .basis import BasisStep, fista, soft, top_eigenvalue
from .blocks import check_cells, dense, lists, vector
from .group_stats import CROSS, FLUSH_CELLS, GRAM, PARTIAL, SCALARS, SUM_H, GroupState, _Sums, add_arrays, array_sums, partial_matrix, ragged
from .weights import NotConverged, weight_kernel

KEYED = "group_id int, first int, scalars array<double>, sum_h array<double>, gram array<double>, cross array<double>"
COPIES = "group_id int, first int, cells array<double>"
BLOCK_CELLS = 1_000_000  # cells of P in one row
PART_CELLS = 8_000_000  # cells of the rows of one group that a task solves with the group's own basis
WALK_CELLS = 20_000_000  # cells of all bases that go along with one inner step


def keyed_groups(partials: DataFrame, width: int, rank: int, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """The partial sums of a pass (``solved_partials``, ``weighted_partials``) as one row per group and block of features, see KEYED.

    Two levels as elsewhere: tasks that share a bucket first, then the few buckets of a group, so a group that all tasks hold rows of is not summed
    by one task from all their parts. Blocks hold about ``block_cells`` cells of P; all of a group's blocks carry its G.
    """
    per_block = min(width, max(1, block_cells // rank))
    keys = ["group_id", "kind", "row"]
    first = partials.repartition(*keys, "bucket").sortWithinPartitions(*keys).mapInArrow(add_arrays, PARTIAL)
    end = F.col("row") + F.size("cells") / F.col("width")  # rows of P may belong to several blocks; all else belongs to each
    low = (F.floor(F.col("row") / per_block) * per_block).cast("int")
    blocks = F.when(F.col("kind") == CROSS, F.sequence(low, (end - 1).cast("int"), F.lit(per_block)))
    placed = first.withColumn("first", F.explode(F.coalesce(blocks, F.sequence(F.lit(0), F.lit(width - 1), F.lit(per_block)))))
    begin = F.greatest("row", "first")
    cut = F.slice("cells", (begin - F.col("row")) * F.col("width") + 1, ((F.least(end, F.col("first") + per_block) - begin) * F.col("width")).cast("int"))
    is_cross = F.col("kind") == CROSS
    placed = placed.select(
        "group_id", "first", "kind", F.when(is_cross, begin).otherwise(F.col("row")).alias("row"), "width", F.when(is_cross, cut).otherwise(F.col("cells")).alias("cells")
    )
    placed = placed.repartition("group_id", "first").sortWithinPartitions("group_id", "first")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        parts: list[np.ndarray] = []
        key, held = None, 0

        def send() -> Iterator[pa.RecordBatch]:
            if done:
                ids = [pa.array([d[k] for d in done], pa.int32()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ids, *(ragged([d[2][k] for d in done]) for k in range(4))], names=["group_id", "first", "scalars", "sum_h", "gram", "cross"])
            done.clear()

        for batch in batches:
            columns = zip(*(vector(batch, c).tolist() for c in ("group_id", "first", "kind", "row", "width")), strict=True)
            column = batch.column("cells")
            flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            for (group, begin, kind, row, per_row), low, high in zip(columns, offsets, offsets[1:], strict=False):
                if (group, begin) != key:
                    if held > FLUSH_CELLS:
                        yield from send()
                        held = 0
                    key, features = (group, begin), min(per_block, width - begin)
                    parts = [np.zeros(SCALARS), np.zeros(rank * 2), np.zeros(rank * rank), np.zeros(features * rank)]
                    done.append((group, begin, parts))
                    held += sum(p.size for p in parts)
                start = (row - (begin if kind == CROSS else 0)) * per_row
                parts[kind][start : start + high - low] += flat[low:high]
        yield from send()

    return placed.mapInArrow(assemble, KEYED)


def _stacks(batch: pa.RecordBatch, rank: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first feature, groups, scalars (b, 5), sum_h (b, r, 2), G (b, r, r), P (b, f, r)) of a batch's rows, block by block of features."""
    first = vector(batch, "first")
    for begin in np.unique(first).tolist():
        part = batch.filter(pa.array(first == begin))
        b = part.num_rows
        yield (
            begin,
            vector(part, "group_id"),
            dense(part, "scalars"),
            dense(part, "sum_h").reshape(b, rank, 2),
            dense(part, "gram").reshape(b, rank, rank),
            dense(part, "cross").reshape(b, -1, rank),
        )


@dataclass(frozen=True)
class Shares:
    """Weights of the groups that sum to one: equal, or by precision, where ``total`` is the sum of all groups' precisions."""

    groups: int
    width: int
    total: float | None = None

    def of(self, scalars: np.ndarray) -> np.ndarray:
        if self.total is None:
            return np.full(len(scalars), 1.0 / self.groups)
        return (4.0 + self.width * scalars[:, 0]) / (scalars[:, 1] + 1.0) / self.total


def _sum_over_groups(keyed: DataFrame, rank: int, terms: Callable[..., dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """Sums by kind of what ``terms`` makes of a stack: arrays (rows, cells), added by task, by bucket of tasks, then over all; rows of CROSS start at the
    block's first feature. The result has the size of one such array for each kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for begin, _, *stack in _stacks(batch, rank):
                for kind, cells in terms(begin, *stack).items():
                    at = (kind, begin if kind == CROSS else 0)
                    held[at] = held[at] + cells if at in held else cells
        for (kind, begin), cells in held.items():
            yield from partial_matrix(cells, kind, begin)

    return array_sums(keyed.mapInArrow(run, PARTIAL))


def keyed_state(keyed: DataFrame, rank: int) -> tuple[GroupState, np.ndarray, np.ndarray]:
    """(state without G and P, summed weights, mean over groups of the scales that set each weight's mean to 1/rank): five numbers per group reach
    the driver."""
    table = keyed.where("first = 0").select("group_id", "scalars").toArrow().combine_chunks()
    ids = table.column("group_id").to_numpy()
    order = np.argsort(ids)
    scalars = np.concatenate([dense(b, "scalars") for b in table.to_batches()])[order]
    sums = _sum_over_groups(keyed.where("first = 0"), rank, lambda begin, s, h, g, p: {SUM_H: np.column_stack([h.sum(axis=0), _scales(s, h).sum(axis=0)])})[SUM_H]
    nothing = np.zeros((0, rank))
    state = GroupState(ids[order], *scalars[:, :4].T, nothing, np.zeros((0, rank, rank)), None, sums[:, 1], int(scalars[:, 4].sum()))
    return state, sums[:, 0], sums[:, 2] / len(ids)


def _scales(scalars: np.ndarray, sum_h: np.ndarray) -> np.ndarray:
    s = sum_h[:, :, 0] * sum_h.shape[1] / scalars[:, :1]
    return np.where(s > 0, s, 1.0)


def rescale_keyed(keyed: DataFrame, rank: int, scale: np.ndarray | None = None) -> DataFrame:
    """Weights scaled so that their means are 1/rank, done on the statistics: by each group's own scale, or by one for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, ids, scalars, sum_h, gram, cross in _stacks(batch, rank):
                s = _scales(scalars, sum_h) if scale is None else np.broadcast_to(scale, (len(ids), rank))
                parts = [scalars, np.stack([sum_h[:, :, 0] / s, sum_h[:, :, 1]], axis=2), gram / s[:, :, None] / s[:, None, :], cross / s[:, None, :]]
                columns = [pa.array(ids, pa.int32()), pa.array(np.full(len(ids), begin, np.int32)), *(lists(x.reshape(len(ids), -1)) for x in parts)]
                yield pa.RecordBatch.from_arrays(columns, names=["group_id", "first", "scalars", "sum_h", "gram", "cross"])

    return keyed.mapInArrow(run, KEYED)


class _Copies:
    """A stack of groups' copies of a block of the basis, and their duals, after the steps whose bases are given."""

    def __init__(self, step: BasisStep, groups: int, walk: list[np.ndarray], pooled: tuple[np.ndarray, np.ndarray] | None) -> None:
        self.step, self.groups, self.walk, self.pooled = step, groups, walk, pooled

    def after_walk(self, begin: int, gram: np.ndarray, cross: np.ndarray) -> tuple[np.ndarray, np.ndarray | float]:
        rows = slice(begin, begin + cross.shape[1])
        walk = [w[rows] for w in self.walk]
        return self._admm(gram, cross, walk) if self.step.solver == "admm" else (self._cease(gram, cross, walk[-1], rows), 0.0)

    def _admm(self, gram: np.ndarray, cross: np.ndarray, walk: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        rho = self.step.hyper
        inverse = np.linalg.inv(np.eye(gram.shape[1]) + gram / rho)
        copies, dual = cross, np.zeros_like(cross)
        for k, w in enumerate(walk):
            if k:
                dual = dual + copies - w
            copies = (cross / rho + w - dual) @ inverse
        return copies, dual

    def _cease(self, gram: np.ndarray, cross: np.ndarray, w: np.ndarray, rows: slice) -> np.ndarray:
        gamma = self.step.hyper
        regular = gram + gamma * np.eye(gram.shape[1])
        mean_gram, mean_cross = self.pooled
        shared = w @ mean_gram - mean_cross[rows]
        if not self.step.lam:
            return w - shared @ np.linalg.inv(regular)
        right = gamma * w + w @ gram - shared
        bound = top_eigenvalue(regular)[:, None, None]
        begin = np.broadcast_to(w, cross.shape)
        return fista(lambda v: v @ regular - right, begin, bound, self.step.lam / self.groups, self.step.local_iter, self.step.momentum)


@dataclass
class KeyedUpdate:
    """One basis update: the new basis, the mean distance of the groups' copies from it, and the copies as a table if asked for."""

    basis: np.ndarray
    violation: float
    copies: DataFrame | None


def update_keyed_basis(keyed: DataFrame, step: BasisStep, start: np.ndarray, shares: Shares, want_copies: bool = False) -> KeyedUpdate:
    """The update from keyed groups, equal to ``BasisStep.solve`` on the same statistics (``step.omega`` is not looked at).

    Every inner step of ADMM and CEASE is one map over the groups and one sum of the basis' size; the stop rule is applied to those sums. ADMM
    sends all bases of the walk with each step, CEASE the last one and the pooled statistics. The gradient solvers need the pooled statistics alone, one sum.
    """
    rank = start.shape[1]
    admm = step.solver == "admm"
    check_cells(start.size * ((step.steps() + 1) if admm else 3), WALK_CELLS, "the bases of one update")
    pooled = None
    if not admm:
        sums = _sum_over_groups(
            keyed,
            rank,
            lambda begin, s, h, g, p: {CROSS: np.tensordot(shares.of(s), p, axes=1)} | ({GRAM: np.tensordot(shares.of(s), g, axes=1)} if begin == 0 else {}),
        )
        pooled = sums[GRAM], sums[CROSS]
    if step.solver in ("agd", "ista"):
        w, _ = replace(step, lam=step.lam / shares.groups, omega=np.ones(1)).solve(pooled[1][:, None, :], pooled[0][None], start)
        return KeyedUpdate(w, 0.0, None)
    walk = [start]
    for turn in range(1, step.steps() + 1):
        local = _Copies(step, shares.groups, walk if admm else walk[-1:], pooled)

        def terms(begin, scalars, sum_h, gram, cross, local=local):
            copies, dual = local.after_walk(begin, gram, cross)
            return {CROSS: np.tensordot(shares.of(scalars), copies + dual, axes=1)}

        w = _sum_over_groups(keyed, rank, terms)[CROSS]
        if admm and step.lam:
            w = soft(w, step.lam / (shares.groups * step.hyper))
        walk.append(w)
        if admm and step.stops(turn, float(np.linalg.norm(w - walk[-2])), float(np.linalg.norm(start))):
            break
    last = _Copies(step, shares.groups, walk[:-1] if admm else walk[-2:-1], pooled)
    end = walk[-1]

    def copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, ids, _, _, gram, cross in _stacks(batch, rank):
                copies, _ = last.after_walk(begin, gram, cross)
                columns = [pa.array(ids, pa.int32()), pa.array(np.full(len(ids), begin, np.int32)), lists(copies.reshape(len(ids), -1))]
                yield pa.RecordBatch.from_arrays(columns, names=["group_id", "first", "cells"])

    def gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, ids, _, _, gram, cross in _stacks(batch, rank):
                away = last.after_walk(begin, gram, cross)[0] - end[begin : begin + cross.shape[1]]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(np.square(away).sum(axis=(1, 2)))], names=["group_id", "gap"])

    apart = keyed.mapInArrow(gaps, "group_id int, gap double").groupBy("group_id").agg(F.sqrt(F.sum("gap")).alias("gap"))
    violation = float(apart.agg(F.avg("gap")).first()[0])
    copies = write_scratch(keyed.mapInArrow(copied, COPIES), "copies") if want_copies else None
    return KeyedUpdate(end, violation, copies)


def part_rows(df: DataFrame, width: int, part_cells: int = PART_CELLS) -> DataFrame:
    """``df`` with a column ``part``, laid out by (group_id, part): a group's rows in as many parts as hold ``part_cells`` cells each, by row key.

    A group with a third of the table becomes many parts. Only groups of more than one part are joined to the rows.
    """
    most = max(1, part_cells // width)
    large = df.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    large = large.select("group_id", F.ceil(F.col("n") / most).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("row_id"), F.coalesce("parts", F.lit(1))).cast("int")
    return df.join(large, "group_id", "left").withColumn("part", part).drop("parts").repartition("group_id", "part")


def _with_own_basis(parts: DataFrame, copies: DataFrame, shared: np.ndarray, fn: Callable, schema: StructType) -> DataFrame:
    """``fn(rows, basis)`` for every (group, part) with the group's own basis, or the shared one where it has none."""
    width, rank = shared.shape
    places = parts.select(F.col("group_id").alias("of"), F.col("part").alias("place")).distinct()
    own = copies.join(places, F.col("group_id") == F.col("of")).select("group_id", F.col("place").alias("part"), "first", "cells")

    def run(rows: pa.Table, blocks: pa.Table) -> pa.Table:
        basis = shared
        if blocks.num_rows:
            basis = np.empty((width, rank))
            for begin, cells in zip(blocks.column("first").to_pylist(), blocks.column("cells"), strict=True):
                block = cells.values.to_numpy(zero_copy_only=False).reshape(-1, rank)
                basis[begin : begin + len(block)] = block
        batches = [out for batch in rows.combine_chunks().to_batches() if batch.num_rows for out in fn(batch, basis)]
        return pa.Table.from_batches(batches) if batches else to_arrow_schema(schema).empty_table()

    return parts.groupBy("group_id", "part").cogroup(own.groupBy("group_id", "part")).applyInArrow(run, schema)


def own_basis_partials(parts: DataFrame, copies: DataFrame, shared: np.ndarray, mode: str, alpha: float | Sequence[float], eps: float) -> DataFrame:
    """Partial sums of a pass whose weights see their group's own copy, from ``part_rows`` of a feature table."""

    def solve(batch: pa.RecordBatch, basis: np.ndarray) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        groups, x = vector(batch, "group_id"), dense(batch)
        sums.add(groups, x, *weight_kernel(basis, mode, alpha, eps)(groups, x))
        yield from sums.flush()

    return _with_own_basis(parts, copies, shared, solve, StructType.fromDDL(PARTIAL))


def own_basis_weights(
    df: DataFrame, copies: DataFrame, shared: np.ndarray, mode: str, alpha: float | Sequence[float], eps: float, keep: Sequence[str] = ()
) -> DataFrame:
    """``row_id, group_id, h``: weights of every row for its group's own copy, or the shared basis where the group has none. Columns to keep pass through."""
    carried = [c for c in keep if c not in ("row_id", "group_id")]
    kernel_options = (mode, alpha, eps)

    def solve(batch: pa.RecordBatch, basis: np.ndarray) -> Iterator[pa.RecordBatch]:
        h, _, open_rows = weight_kernel(basis, *kernel_options)(vector(batch, "group_id"), dense(batch))
        if open_rows.any():
            raise NotConverged(f"weights have not converged at row_id {batch.column('row_id')[int(np.argmax(open_rows))]}")
        columns = [batch.column(c) for c in ("row_id", "group_id", *carried)]
        yield pa.RecordBatch.from_arrays([*columns, lists(h)], names=["row_id", "group_id", *carried, "h"])

    rows = df.select("row_id", "group_id", *carried, *([] if "features" in carried else ["features"]))
    fields = [f for c in ("row_id", "group_id", *carried) for f in rows.select(c).schema]
    schema = StructType([*fields, StructField("h", ArrayType(DoubleType()))])
    return _with_own_basis(part_rows(rows, shared.shape[0]), copies, shared, solve, schema)
