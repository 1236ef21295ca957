"""Sufficient statistics per group: one pass over the rows, one keyed sum.

The statistics of a group are its row count, squared error, summed log weights, summed squares of the
features, rows whose weights have not converged, summed weights and logs of weights per component,
G = sum h h' (rank x rank) and P = sum x h' (features x rank).

Every task adds up its own rows first and sends each matrix as a few rows with an array of cells, one for each
(group, kind, block of cells). These are added in two levels: tasks that share a bucket in numpy, then the few buckets by an ordinary
hash aggregate of long rows ``group_id, kind, i, j, value``, whose number does not depend on the number of tasks. A group of any size
is therefore summed by all tasks that hold its rows, and no task adds up all partial sums of a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import TooLarge, check_cells, dense, grouped_rows, lists, vector
from .weights import Bases, weight_kernel

LONG = "group_id int, kind tinyint, i int, j int, value double"
SCALAR, SUM_H, GRAM, CROSS = 0, 1, 2, 3
SCALARS = 5
POOLED = 2  # added to GRAM and CROSS where they are summed over all groups (under group 0)
FLUSH_CELLS = 4_000_000
SLAB_ROWS = 1_000_000
PARTIAL = "group_id int, kind tinyint, row int, width int, bucket int, cells array<double>"
PARTIAL_CELLS = 65_536  # cells of one row of partial sums
BUCKETS = 16  # that the tasks of a pass are dealt to
TILE, HELD_BYTES = 512, 64_000_000  # columns of a Gram tile, and rows a task holds to make its tiles from


class _Sums:
    """What one task has added up so far: at most FLUSH_CELLS or eight groups, plus one batch.

    Groups share dense arrays, one slot each, so that a task with hundreds of groups per batch adds
    and emits them together. With ``pool`` the matrices are summed over all groups.
    """

    def __init__(self, pool: bool = False) -> None:
        self.pool = pool
        self.slots: dict[int, int] = {}
        self.parts: list[np.ndarray] = []

    def add(
        self, groups: np.ndarray, x: np.ndarray, h: np.ndarray, sse: np.ndarray | None, open_rows: np.ndarray | None = None
    ) -> None:
        order = np.argsort(groups, kind="stable")
        ids, starts = np.unique(groups[order], return_index=True)
        at = self._slots_of(ids, x.shape[1], h.shape[1])
        scalars, sum_h, gram, cross = self.parts
        if self.pool:
            gram[0] += h.T @ h
            cross[0] += x.T @ h
        logs, none = np.log(np.maximum(h, 1e-300)), np.zeros(len(x))
        rows = np.stack(
            [
                np.ones(len(x)),
                none if sse is None else sse,
                logs.sum(axis=1),
                np.einsum("ij,ij->i", x, x),
                none if open_rows is None else open_rows,
            ],
            axis=1,
        )
        both = np.stack([h, logs], axis=2)
        if len(ids) > 1:
            rows, h, both = rows[order], h[order], both[order]
        scalars[at] += np.add.reduceat(rows, starts, axis=0)
        sum_h[at] += np.add.reduceat(both, starts, axis=0)
        if not self.pool:
            x = x[order] if len(ids) > 1 else x
            for slot, first, last in zip(at, starts, np.append(starts[1:], len(x))):
                part = h[first:last]
                gram[slot] += part.T @ part
                cross[slot] += x[first:last].T @ part

    def _slots_of(self, ids: np.ndarray, width: int, rank: int) -> np.ndarray:
        for g in ids.tolist():
            self.slots.setdefault(g, len(self.slots))
        if not self.parts:
            matrices = int(self.pool)
            self.parts = [np.zeros((0, SCALARS)), np.zeros((0, rank, 2))]
            self.parts += [np.zeros((matrices, rank, rank)), np.zeros((matrices, width, rank))]
        have, need = len(self.parts[0]), len(self.slots)
        if need > have:
            more = max(need, min(2 * have, have + 1024)) - have
            grown = [np.concatenate([p, np.zeros((more, *p.shape[1:]))]) for p in self.parts[: 2 if self.pool else 4]]
            self.parts[: len(grown)] = grown
        return np.array([self.slots[g] for g in ids.tolist()])

    def full(self) -> bool:
        per_group = sum(p[0].size for p in self.parts[: 2 if self.pool else 4]) if self.slots else 0
        return len(self.slots) > 8 and len(self.slots) * per_group > FLUSH_CELLS

    def flush(self) -> Iterator[pa.RecordBatch]:
        every = np.fromiter(self.slots, dtype=np.int32, count=len(self.slots))
        for kind, part in enumerate(self.parts):
            ids = every
            if self.pool and kind >= GRAM:
                ids, kind = np.zeros(1, dtype=np.int32), kind + POOLED
            cells = part[: len(ids)].reshape(len(ids), part.shape[1], -1)
            per_row = cells.shape[2]
            step = max(1, PARTIAL_CELLS // per_row)
            for row in range(0, part.shape[1], step):
                block = cells[:, row : row + step]
                slab = max(1, SLAB_ROWS // max(1, block[0].size))
                for first in range(0, len(ids), slab):
                    yield _partial_rows(ids[first : first + slab], kind, row, per_row, block[first : first + slab])
        self.slots, self.parts = {}, []


def _partial_rows(ids: np.ndarray, kind: int, row: int, width: int, block: np.ndarray) -> pa.RecordBatch:
    n = len(ids)
    columns = [pa.array(np.full(n, v), t) for v, t in ((kind, pa.int8()), (row, pa.int32()), (width, pa.int32()))]
    task = TaskContext.get()
    bucket = pa.array(np.full(n, task.partitionId() % BUCKETS if task else 0), pa.int32())
    cells = lists(block.reshape(n, -1))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids), *columns, bucket, cells], names=["group_id", "kind", "row", "width", "bucket", "cells"]
    )


def _add_partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Long rows of the sums of partial rows with equal (group, kind, first row); what is held is let go once it is large."""
    held: dict[tuple[int, int, int, int], np.ndarray] = {}
    size = 0

    def let_go() -> Iterator[pa.RecordBatch]:
        some, cells = [], 0
        for key, total in held.items():
            some.append((key, total))
            cells += total.size
            if cells >= SLAB_ROWS:
                yield _long_rows(some)
                some, cells = [], 0
        if some:
            yield _long_rows(some)
        held.clear()

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = zip(*(vector(batch, c).tolist() for c in ("group_id", "kind", "row", "width")), strict=True)
        column = batch.column("cells")
        offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
        for key, first, last in zip(keys, offsets, offsets[1:], strict=False):
            if key in held:
                held[key] += flat[first:last]
            else:
                held[key] = flat[first:last].copy()
                size += int(last - first)
        if size > 2 * FLUSH_CELLS:
            yield from let_go()
            size = 0
    yield from let_go()


def _long_rows(sums: list[tuple[tuple[int, int, int, int], np.ndarray]]) -> pa.RecordBatch:
    sizes = np.array([total.size for _, total in sums])
    group, kind, row, width = np.array([key for key, _ in sums]).T
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    per_row = np.repeat(width, sizes)
    columns = [
        pa.array(np.repeat(group, sizes).astype(np.int32)),
        pa.array(np.repeat(kind, sizes).astype(np.int8)),
        pa.array((np.repeat(row, sizes) + place // per_row).astype(np.int32)),
        pa.array((place % per_row).astype(np.int32)),
        pa.array(np.concatenate([total for _, total in sums])),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["group_id", "kind", "i", "j", "value"])


def _summed(partials: DataFrame) -> DataFrame:
    """Both levels of the sum: buckets of tasks for each block of cells, then the buckets."""
    dealt = partials.repartition("group_id", "kind", "row", "bucket")
    return dealt.mapInArrow(_add_partials, LONG).groupBy("group_id", "kind", "i", "j").agg(F.sum("value").alias("value"))


def ragged(rows: Sequence[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([r.size for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.ravel(r) for r in rows]) if rows else np.zeros(0)))


def add_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of partial rows with equal (group, kind, first row), in order of these; memory is about FLUSH_CELLS."""
    names = ["group_id", "kind", "row", "width", "bucket", "cells"]
    types = (pa.int32(), pa.int8(), pa.int32(), pa.int32(), pa.int32())
    rows: list[tuple] = []
    held = 0

    def sent(rows: list[tuple]) -> pa.RecordBatch:
        keys = zip(*(key for key, _ in rows), strict=True)
        return pa.RecordBatch.from_arrays([*(pa.array(k, t) for k, t in zip(keys, types, strict=True)), ragged([cells for _, cells in rows])], names=names)

    for batch in batches:
        keys = zip(*(vector(batch, c).tolist() for c in names[:5]), strict=True)
        column = batch.column("cells")
        flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        for key, first, last in zip(keys, offsets, offsets[1:], strict=False):
            if rows and rows[-1][0][:3] == key[:3]:
                rows[-1][1][:] += flat[first:last]
                continue
            if held > FLUSH_CELLS:
                yield sent(rows)
                rows, held = [], 0
            rows.append((key, flat[first:last].copy()))
            held += int(last - first)
    if rows:
        yield sent(rows)


def partial_matrix(cells: np.ndarray, kind: int = 0, row: int = 0) -> Iterator[pa.RecordBatch]:
    """One task's share of a sum of matrices, rows counted from ``row``, as partial rows of group 0."""
    step = max(1, PARTIAL_CELLS // cells.shape[1])
    for k in range(0, len(cells), step):
        yield _partial_rows(np.zeros(1, np.int32), kind, row + k, cells.shape[1], cells[None, k : k + step])


def array_sums(partials: DataFrame) -> dict[int, np.ndarray]:
    """Summed matrices by kind, on the driver, from the partial rows that ``partial_matrix`` makes in each task.

    Blocks of cells are added in two levels, by bucket of tasks and then over buckets, as arrays throughout. For matrices whose size has been checked.
    """
    keys = ["group_id", "kind", "row"]
    for deal in (["kind", "row", "bucket"], ["kind", "row"]):
        partials = partials.repartition(*deal).sortWithinPartitions(*keys).mapInArrow(add_arrays, PARTIAL)
    table = partials.select("kind", "row", "width", "cells").toArrow()
    found: dict[int, list[tuple[int, np.ndarray]]] = {}
    for batch in table.to_batches():
        rows = zip(*(vector(batch, c).tolist() for c in ("kind", "row", "width")), batch.column("cells"), strict=True)
        for kind, row, width, cells in rows:
            found.setdefault(kind, []).append((row, cells.values.to_numpy(zero_copy_only=False).reshape(-1, width)))
    out = {}
    for kind, blocks in found.items():
        out[kind] = np.zeros((max(row + len(block) for row, block in blocks), blocks[0][1].shape[1]))
        for row, block in blocks:
            out[kind][row : row + len(block)] = block
    return out


def solved_statistics(
    df: DataFrame,
    bases: Bases,
    mode: str = "simplex",
    alpha: float | np.ndarray = 0.1,
    eps: float = 1e-5,
    pool: bool = False,
) -> DataFrame:
    """Solve every row's weights for a basis and keep only the statistics; ``df`` may be packed.

    With ``pool`` G and P are summed over all groups within the tasks already.
    """
    return _summed(solved_partials(df, bases, mode, alpha, eps, pool))


def solved_partials(
    df: DataFrame, bases: Bases, mode: str = "simplex", alpha: float | np.ndarray = 0.1, eps: float = 1e-5, pool: bool = False
) -> DataFrame:
    """What the tasks of ``solved_statistics`` have added up, see PARTIAL."""
    kernel = weight_kernel(bases, mode, alpha, eps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(pool)
        for batch in batches:
            for groups, x in grouped_rows(batch):
                sums.add(groups, x, *kernel(groups, x))
            if sums.full():
                yield from sums.flush()
        yield from sums.flush()

    rows = df.select("width", "groups", "cells") if "cells" in df.columns else df.select("group_id", "features")
    return rows.mapInArrow(run, PARTIAL)


def stacked_statistics(
    df: DataFrame, bases: Sequence[Bases], groups: np.ndarray, mode: str = "simplex", alpha: float | np.ndarray = 0.1, eps: float = 1e-5
) -> DataFrame:
    """``solved_statistics`` for several bases in one pass over the rows: ``group_id`` is the basis' position times the number of groups, plus the
    group's place among the sorted ``groups``."""
    kernels = [weight_kernel(b, mode, alpha, eps) for b in bases]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for batch in batches:
            for ids, x in grouped_rows(batch):
                at = np.searchsorted(groups, ids)
                for k, kernel in enumerate(kernels):
                    sums.add((k * len(groups) + at).astype(np.int32), x, *kernel(ids, x))
                    if sums.full():
                        yield from sums.flush()
        yield from sums.flush()

    rows = df.select("width", "groups", "cells") if "cells" in df.columns else df.select("group_id", "features")
    return _summed(rows.mapInArrow(run, PARTIAL))


def read_stacked(stats: DataFrame, runs: int, groups: np.ndarray, width: int, rank: int, max_cells: int = 20_000_000) -> list[GroupState]:
    """The states of ``stacked_statistics``, one for each basis, after a check of their size together."""
    c = len(groups)
    check_cells(runs * c * (rank * rank + 2 * rank + SCALARS + width * rank), max_cells, "the group statistics of all runs")
    table = stats.toArrow()
    gid, kind, i, j, v = (table.column(k).to_numpy() for k in ("group_id", "kind", "i", "j", "value"))
    out = []
    for k in range(runs):
        own = gid // c == k
        out.append(state_from_cells(groups[gid[own] - k * c], kind[own], i[own], j[own], v[own], groups, width, rank))
    return out


def weighted_statistics(df: DataFrame, bases: Bases | None = None, centre: np.ndarray | None = None) -> DataFrame:
    """The same statistics for weights given in column ``h`` (squared error only with a basis); with ``centre`` of X - centre H in place of X."""
    return _summed(weighted_partials(df, bases, centre))


def weighted_partials(df: DataFrame, bases: Bases | None = None, centre: np.ndarray | None = None) -> DataFrame:
    """What the tasks of ``weighted_statistics`` have added up, see PARTIAL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for batch in batches:
            if not batch.num_rows:
                continue
            groups, x, h = vector(batch, "group_id"), dense(batch), dense(batch, "h")
            if centre is not None:
                x = x - h @ centre.T
            sse = None
            if isinstance(bases, np.ndarray):
                gap = x - h @ bases.T
                sse = np.einsum("ij,ij->i", gap, gap)
            elif bases is not None:
                sse = np.empty(x.shape[0])
                order = np.argsort(groups, kind="stable")
                ids, starts = np.unique(groups[order], return_index=True)
                for g, mine in zip(ids, np.split(order, starts[1:]), strict=True):
                    gap = x[mine] - h[mine] @ bases[int(g)].T
                    sse[mine] = np.einsum("ij,ij->i", gap, gap)
            sums.add(groups, x, h, sse)
            if sums.full():
                yield from sums.flush()
        yield from sums.flush()

    return df.select("group_id", "features", "h").mapInArrow(run, PARTIAL)


def upper_gram(
    df: DataFrame,
    column: str = "features",
    *,
    norms: bool = False,
    max_width: int | None = None,
    tile: int = TILE,
    held_bytes: int = HELD_BYTES,
) -> DataFrame:
    """``group_id, i, j, value``: per group sum of x_i x_j for i <= j.

    A task holds rows of about ``held_bytes`` and sends, group by group, their products as tiles of ``tile`` x ``tile`` cells; tiles with equal
    (group, i-block, j-block) are added one after the other, first by bucket of tasks, then over buckets. So no process ever holds
    more than its rows and one tile, whatever the width. With ``norms`` the sums of |x_i| come along as j = width. Rows wider than
    ``max_width`` raise in the first task that sees one.
    """
    names = ["group_id", "a", "b", "width", "bucket", "cells"]

    def products(groups: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        bucket, width = task.partitionId() % BUCKETS if task else 0, x.shape[1]
        order = np.argsort(groups, kind="stable")
        ids, starts = np.unique(groups[order], return_index=True)
        rows: list[tuple] = []
        for g, members in zip(ids.tolist(), np.split(order, starts[1:]), strict=True):
            mine = x if len(ids) == 1 else x[members]
            for a in range(0, width, tile):
                if norms:
                    rows.append((g, a, width, width, bucket, np.abs(mine[:, a : a + tile]).sum(axis=0)))
                for b in range(a, width, tile):
                    rows.append((g, a, b, width, bucket, (mine[:, a : a + tile].T @ mine[:, b : b + tile]).ravel()))
                    if sum(r[5].size for r in rows[-64:]) > SLAB_ROWS or len(rows) >= 512:
                        yield _tile_rows(rows, names)
                        rows = []
        if rows:
            yield _tile_rows(rows, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            groups, x = vector(batch, "group_id"), dense(batch, column)
            if max_width is not None and x.shape[1] > max_width:
                raise TooLarge(f"{x.shape[1]} columns, at most {max_width} allowed for a Gram matrix in one process")
            if held and held[0][1].shape[1] != x.shape[1]:
                raise ValueError(f"{column} has rows of {held[0][1].shape[1]} and of {x.shape[1]} cells")
            held.append((groups, x))
            size += x.nbytes
            if size > held_bytes:
                yield from products(*(np.concatenate(part) for part in zip(*held, strict=True)))
                held, size = [], 0
        if held:
            yield from products(*(np.concatenate(part) for part in zip(*held, strict=True)))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for batch in batches:
            keys = zip(*(vector(batch, c).tolist() for c in names[:5]), strict=True)
            for here, cells in zip(keys, batch.column("cells"), strict=True):
                values = cells.values.to_numpy(zero_copy_only=False)
                if here == key:
                    total += values
                    continue
                if key is not None:
                    yield _tile_rows([(*key, total)], names)
                key, total = here, values.copy()
        if key is not None:
            yield _tile_rows([(*key, total)], names)

    def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in added(batches):
            group, a, b, width = (int(vector(batch, c)[0]) for c in names[:4])
            cells = batch.column("cells").values.to_numpy(zero_copy_only=False)
            if b == width:  # sums of absolute values
                i, j = np.arange(a, a + len(cells)), np.full(len(cells), width)
            else:
                block = cells.reshape(min(tile, width - a), -1)
                i, j = np.nonzero(np.arange(a, a + block.shape[0])[:, None] <= np.arange(b, b + block.shape[1])[None, :])
                i, j, cells = i + a, j + b, block[i, j]
            columns = [pa.array(np.full(len(cells), group), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(cells)]
            yield pa.RecordBatch.from_arrays(columns, names=["group_id", "i", "j", "value"])

    tiles = "group_id int, a int, b int, width int, bucket int, cells array<double>"
    keys = ["group_id", "a", "b"]
    partials = df.select("group_id", column).mapInArrow(run, tiles)
    first = partials.repartition(*keys, "bucket").sortWithinPartitions(*keys, "bucket").mapInArrow(added, tiles)
    second = first.withColumn("bucket", F.lit(0)).repartition(*keys).sortWithinPartitions(*keys)
    return second.mapInArrow(cells_of, "group_id int, i int, j int, value double")


def _tile_rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    *keys, cells = zip(*rows, strict=True)
    offsets = np.concatenate([[0], np.cumsum([c.size for c in cells])]).astype(np.int32)
    payload = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(cells)))
    return pa.RecordBatch.from_arrays([*(pa.array(k, pa.int32()) for k in keys), payload], names=names)


def group_gram(df: DataFrame, column: str = "features", tile: int = TILE) -> DataFrame:
    """``group_id, i, j, value``: per group sum of x_i x_j, both triangles (mirrored after the shuffle)."""
    upper = upper_gram(df, column, tile=tile)
    both = F.when(
        F.col("i") < F.col("j"),
        F.array(F.struct(F.col("i"), F.col("j")), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))),
    ).otherwise(F.array(F.struct(F.col("i"), F.col("j"))))
    return upper.select("group_id", F.explode(both).alias("_at"), "value").select(
        "group_id", F.col("_at.i").alias("i"), F.col("_at.j").alias("j"), "value"
    )


def gram(df: DataFrame, column: str = "features", tile: int = TILE) -> DataFrame:
    """``i, j, value`` of X'X over the whole table."""
    whole = group_gram(df.select(F.lit(0).alias("group_id"), column), column, tile)
    return whole.select("i", "j", "value")


def gram_matrix(df: DataFrame, column: str = "features", max_cells: int = 20_000_000) -> np.ndarray:
    """X'X on the driver, from one pass; only for widths whose square stays under ``max_cells``."""
    return gram_and_norms(df, column, max_cells, norms=False)[0]


def gram_and_norms(
    df: DataFrame, column: str = "features", max_cells: int = 20_000_000, norms: bool = True
) -> tuple[np.ndarray, np.ndarray]:
    """(X'X, column L1 norms) on the driver, from one pass over the rows."""
    whole = df.select(F.lit(0).alias("group_id"), column)
    cells = upper_gram(whole, column, norms=norms, max_width=math.isqrt(max_cells)).toArrow()
    i, j, v = (cells.column(c).to_numpy() for c in ("i", "j", "value"))
    width = int(i.max()) + 1 if len(i) else 0
    out, l1 = np.zeros((width, width)), np.zeros(width)
    inside = j < width
    out[i[inside], j[inside]] = v[inside]
    out[j[inside], i[inside]] = v[inside]
    l1[i[~inside]] = v[~inside]
    return out, l1


@dataclass
class GroupState:
    """Statistics of all groups on the driver; ``cross`` is None while P stays in Spark."""

    groups: np.ndarray  # (C,)
    n: np.ndarray  # (C,)
    sse: np.ndarray  # (C,)
    log_h: np.ndarray  # (C,)
    squares: np.ndarray  # (C,)
    sum_h: np.ndarray  # (C, r)
    gram: np.ndarray  # (C, r, r)
    cross: np.ndarray | None  # (m, C, r)
    logs: np.ndarray | None = None  # (r,), over all groups
    unconverged: int = 0

    @property
    def variances(self) -> np.ndarray:
        """Posterior mode of each group's noise variance under an inverse-gamma(1, 1/2) prior."""
        if self.cross is None:
            raise ValueError("the width is needed; use noise_variances(state, width)")
        return noise_variances(self, self.cross.shape[0])


def noise_variances(state: GroupState, width: int) -> np.ndarray:
    """(sse_c + 1) / (4 + width * n_c)."""
    return (state.sse + 1.0) / (4.0 + width * state.n)


def read_state(
    stats: DataFrame, groups: np.ndarray, width: int, rank: int, *, with_cross: bool = True, max_cells: int = 20_000_000
) -> GroupState:
    """Bring statistics to the driver, after checking how large they are."""
    c = len(groups)
    check_cells(c * (rank * rank + 2 * rank + SCALARS + (width * rank if with_cross else 0)), max_cells, "the group statistics")
    table = (stats if with_cross else stats.filter(F.col("kind") != CROSS)).toArrow()
    cells = (table.column(k).to_numpy() for k in ("group_id", "kind", "i", "j", "value"))
    return state_from_cells(*cells, groups, width, rank, with_cross)


def read_whole_state(stats: DataFrame, max_cells: int = 20_000_000) -> tuple[GroupState, int, int]:
    """(state, width, rank) where groups and sizes are not known beforehand; more than ``max_cells`` rows raise."""
    table = stats.limit(max_cells + 1).toArrow()
    check_cells(table.num_rows, max_cells, "the group statistics")
    gid, kind, i, j, v = (table.column(k).to_numpy() for k in ("group_id", "kind", "i", "j", "value"))
    cross = kind == CROSS
    width, rank = int(i[cross].max()) + 1, int(j[cross].max()) + 1
    return state_from_cells(gid, kind, i, j, v, np.unique(gid), width, rank), width, rank


def state_from_cells(
    gid: np.ndarray,
    kind: np.ndarray,
    i: np.ndarray,
    j: np.ndarray,
    v: np.ndarray,
    groups: np.ndarray,
    width: int,
    rank: int,
    with_cross: bool = True,
) -> GroupState:
    """Dense statistics from their long rows."""
    c = len(groups)
    at = np.searchsorted(groups, gid)
    scalars, sum_h = np.zeros((c, SCALARS)), np.zeros((c, rank, 2))
    g, p = np.zeros((c, rank, rank)), np.zeros((width, c, rank)) if with_cross else None
    pick = kind == SCALAR
    scalars[at[pick], i[pick]] = v[pick]
    pick = kind == SUM_H
    sum_h[at[pick], i[pick], j[pick]] = v[pick]
    pick = kind == GRAM
    g[at[pick], i[pick], j[pick]] = v[pick]
    if p is not None:
        pick = kind == CROSS
        p[i[pick], at[pick], j[pick]] = v[pick]
    logs, unconverged = sum_h[:, :, 1].sum(axis=0), int(scalars[:, 4].sum())
    return GroupState(groups, *scalars[:, :4].T, sum_h[:, :, 0], g, p, logs, unconverged)


def read_pooled(
    stats: DataFrame, groups: np.ndarray, width: int, rank: int, max_cells: int = 20_000_000
) -> GroupState:
    """State of a pass with ``pool``: counts and errors per group, one G and one P (summed over groups)."""
    c = len(groups)
    check_cells(c * (2 * rank + SCALARS) + width * rank + rank * rank, max_cells, "the pooled statistics")
    table = stats.toArrow()
    gid, kind, i, j, v = (table.column(k).to_numpy() for k in ("group_id", "kind", "i", "j", "value"))
    own = kind < GRAM
    per_group = state_from_cells(gid[own], kind[own], i[own], j[own], v[own], groups, 0, rank)
    shared = ~own
    pooled = state_from_cells(
        gid[shared], kind[shared] - POOLED, i[shared], j[shared], v[shared], np.zeros(1, dtype=np.int32), width, rank
    )
    return replace(per_group, gram=pooled.gram, cross=pooled.cross)


def pooled_state(
    stats: DataFrame, width: int, rank: int, *, noise_aware: bool, max_cells: int = 20_000_000
) -> tuple[GroupState, np.ndarray]:
    """Precision-weighted sums over all groups, added up in Spark: (state of one pseudo-group, variances).

    For tables with so many groups that even their rank x rank matrices are too large for one process. Only the row
    count and squared error of each group come to the driver. Enough for the solvers that use sums
    over groups alone.
    """
    check_cells(width * rank + rank * rank, max_cells, "the pooled statistics")
    scalars = (
        stats.filter(F.col("kind") == SCALAR)
        .groupBy("group_id")
        .agg(*[F.sum(F.when(F.col("i") == k, F.col("value"))).alias(c) for k, c in enumerate(("n", "sse", "log_h", "squares", "open"))])
        .withColumn("variance", (F.col("sse") + 1.0) / (4.0 + width * F.col("n")))
    )
    table = scalars.orderBy("group_id").toArrow()
    groups, n, sse, log_h, squares, unconverged, variances = (
        table.column(c).to_numpy() for c in ("group_id", "n", "sse", "log_h", "squares", "open", "variance")
    )
    per_component = stats.filter((F.col("kind") == SUM_H) & (F.col("j") == 1)).groupBy("i").agg(F.sum("value").alias("value")).orderBy("i")
    logs = per_component.toArrow().column("value").to_numpy()
    share = (1.0 / variances) / (1.0 / variances).sum() if noise_aware else np.full(len(groups), 1.0 / len(groups))
    if noise_aware:
        total = float((1.0 / variances).sum())
        weigh = scalars.select("group_id", (1.0 / F.col("variance") / total).alias("omega"))
        weighted = stats.filter(F.col("kind") >= GRAM).join(weigh, "group_id")
    else:
        weighted = stats.filter(F.col("kind") >= GRAM).withColumn("omega", F.lit(1.0 / len(groups)))
    sums = weighted.groupBy("kind", "i", "j").agg(F.sum(F.col("value") * F.col("omega")).alias("value")).toArrow()
    kind, i, j, v = (sums.column(c).to_numpy() for c in ("kind", "i", "j", "value"))
    g, p = np.zeros((1, rank, rank)), np.zeros((width, 1, rank))
    at = kind == GRAM
    g[0, i[at], j[at]] = v[at]
    at = kind == CROSS
    p[i[at], 0, j[at]] = v[at]
    state = GroupState(groups, n, sse, log_h, squares, np.zeros((len(groups), 0)), g, p, logs, int(unconverged.sum()))
    return state, share


def group_ids(df: DataFrame, max_groups: int = 1_000_000) -> np.ndarray:
    """Sorted group ids; the list of groups is bounded by ``max_groups``."""
    ids = df.select("group_id").distinct().limit(max_groups + 1).toArrow().column("group_id").to_numpy()
    check_cells(len(ids), max_groups, "the list of groups")
    return np.sort(ids)


def rescale_groups(state: GroupState, mode: str = "group") -> tuple[GroupState, np.ndarray]:
    """Scale weights so that their mean is 1/rank: s = sum(h) * rank / n, h -> h/s, basis column -> basis * s.

    Done on the statistics: G -> S^-1 G S^-1, P -> P S^-1. "group" scales each group by its own s,
    "global" scales all by one. A weight that is zero throughout keeps s = 1. Returns the new state
    and s, shape (C, r).
    """
    rank = state.sum_h.shape[1]
    if mode == "group":
        s = state.sum_h * rank / state.n[:, None]
    elif mode == "global":
        s = np.broadcast_to(state.sum_h.sum(axis=0) * rank / state.n.sum(), state.sum_h.shape).copy()
    else:
        raise ValueError(f"unknown rescaling {mode!r}")
    s[s <= 0] = 1.0
    cross = None if state.cross is None else state.cross / s[None, :, :]
    scaled = GroupState(
        state.groups, state.n, state.sse, state.log_h, state.squares, state.sum_h / s,
        state.gram / s[:, :, None] / s[:, None, :], cross, state.logs, state.unconverged,
    )
    return scaled, s
