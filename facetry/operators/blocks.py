"""Arrow batches as dense numpy blocks, and the public block function."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import counter

PACKED = "n int, width int, groups binary, ids binary, cells binary"


class TooLarge(ValueError):
    """A result that would not fit on the driver or in a task closure."""


def check_cells(cells: int, limit: int, what: str) -> None:
    if cells > limit:
        raise TooLarge(f"{what} has {cells} cells, more than the {limit} allowed in one process")


def dense(batch: pa.RecordBatch, column: str = "features") -> np.ndarray:
    """An array column as an (n, m) float64 block, without per-row Python objects."""
    lists = batch.column(column)
    n = len(lists)
    flat = lists.flatten()
    if lists.null_count or flat.null_count:
        raise ValueError(f"{column} holds nulls")
    cells = flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if n == 0:
        return cells.reshape(0, 0)
    lengths = pc.list_value_length(lists).to_numpy()
    width = int(lengths[0])
    if (lengths != width).any():
        odd = int(np.flatnonzero(lengths != width)[0])
        where = f" at row_id {batch.column('row_id')[odd]}" if "row_id" in batch.schema.names else ""
        raise ValueError(f"{column} has {lengths[odd]} cells{where}, expected {width}")
    return cells.reshape(n, width)


def vector(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).to_numpy(zero_copy_only=False)


def lists(block: np.ndarray) -> pa.Array:
    """An (n, m) block as an Arrow list column."""
    n, m = block.shape
    offsets = np.arange(0, n * m + 1, m, dtype=np.int32) if m else np.zeros(n + 1, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(block, dtype=np.float64).ravel()))


def replace_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return batch.set_column(batch.schema.get_field_index(name), name, values)


def pack_blocks(df: DataFrame, block_bytes: int = 4_000_000) -> DataFrame:
    """Rows ``row_id, group_id, features`` as few rows of raw cells, see PACKED.

    For tables that are read again and again: a block crosses to Python as one copy instead of cell
    by cell. A block keeps the order of its rows and holds about ``block_bytes``. Persist the result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = dense(batch)
            groups = vector(batch, "group_id").astype(np.int32)
            ids = vector(batch, "row_id").astype(np.int64)
            per_block = max(1, block_bytes // (8 * x.shape[1]))
            for k in range(0, len(x), per_block):
                part = slice(k, k + per_block)
                raw = [pa.array([np.ascontiguousarray(a[part]).tobytes()], pa.binary()) for a in (groups, ids, x)]
                sizes = [pa.array([len(groups[part])], pa.int32()), pa.array([x.shape[1]], pa.int32())]
                yield pa.RecordBatch.from_arrays(sizes + raw, names=["n", "width", "groups", "ids", "cells"])

    return df.select("row_id", "group_id", "features").mapInArrow(run, PACKED)


def block_facts(blocks: DataFrame, max_groups: int = 1_000_000) -> tuple[int, int, np.ndarray]:
    """(rows, width, sorted group ids) of packed blocks; blocks of different width raise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], int] = {}
        for batch in batches:
            for width, groups in zip(batch.column("width"), batch.column("groups")):
                found, counts = np.unique(np.frombuffer(groups.as_buffer(), dtype=np.int32), return_counts=True)
                for g, n in zip(found.tolist(), counts.tolist()):
                    held[g, width.as_py()] = held.get((g, width.as_py()), 0) + n
        for (g, width), n in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([g], pa.int32()), pa.array([width], pa.int32()), pa.array([n], pa.int64())],
                names=["group_id", "width", "n"],
            )

    facts = blocks.select("width", "groups").mapInArrow(run, "group_id int, width int, n bigint")
    table = facts.groupBy("group_id", "width").agg(F.sum("n").alias("n")).limit(max_groups + 1).toArrow()
    if not table.num_rows:
        raise ValueError("the feature table is empty")
    check_cells(table.num_rows, max_groups, "the list of groups")
    widths = np.unique(table.column("width").to_numpy())
    if len(widths) > 1:
        raise ValueError(f"feature arrays differ in length, from {widths[0]} to {widths[-1]}")
    return int(table.column("n").to_numpy().sum()), int(widths[0]), np.unique(table.column("group_id").to_numpy())


def gather_small(blocks: DataFrame, total_bytes: int, partition_bytes: int = 512_000_000) -> DataFrame:
    """Read several small partitions in one task, without a shuffle; large ones are left alone.

    Every task of a pass sends one set of statistics, so a pass over few large partitions exchanges less. A task reads block by
    block, so its memory does not grow with its partition. No fewer tasks than cores.
    """
    wanted = max(blocks.sparkSession.sparkContext.defaultParallelism, -(-total_bytes // partition_bytes))
    return blocks.coalesce(wanted)


def unpack_drawn(blocks: DataFrame, seed: int, share: float = 1.0, per_block: int | None = None) -> DataFrame:
    """``draw, row_id, features`` of the rows whose ``counter.uniform`` (slot 0) lies below ``share``.

    With ``per_block`` only the lowest draws of each block, enough to find the lowest overall.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, ids, cells in zip(*(batch.column(c) for c in ("width", "ids", "cells"))):
                keys = np.frombuffer(ids.as_buffer(), dtype=np.int64)
                u = counter.uniform(keys, 0, seed)
                chosen = np.flatnonzero(u < share)
                if per_block is not None:
                    chosen = chosen[np.lexsort((keys[chosen], u[chosen]))[:per_block]]
                x = np.frombuffer(cells.as_buffer(), dtype=np.float64).reshape(-1, width.as_py())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(u[chosen]), pa.array(keys[chosen]), lists(x[chosen])], names=["draw", "row_id", "features"]
                )

    rows = blocks.select("width", "ids", "cells")
    return rows.mapInArrow(run, "draw double, row_id bigint, features array<double>")


def unpack_blocks(blocks: DataFrame) -> DataFrame:
    """``row_id, group_id, features`` of packed blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, groups, ids, cells in zip(*(batch.column(c) for c in ("width", "groups", "ids", "cells"))):
                x = np.frombuffer(cells.as_buffer(), dtype=np.float64).reshape(-1, width.as_py())
                columns = [pa.array(np.frombuffer(ids.as_buffer(), dtype=np.int64)), pa.array(np.frombuffer(groups.as_buffer(), dtype=np.int32))]
                yield pa.RecordBatch.from_arrays([*columns, lists(x)], names=["row_id", "group_id", "features"])

    return blocks.select("width", "groups", "ids", "cells").mapInArrow(run, "row_id bigint, group_id int, features array<double>")


def grouped_rows(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(group ids, (n, m) block) pairs of a plain or packed batch."""
    if "cells" not in batch.schema.names:
        if batch.num_rows:
            yield vector(batch, "group_id"), dense(batch)
        return
    for width, groups, cells in zip(*(batch.column(c) for c in ("width", "groups", "cells"))):
        yield (
            np.frombuffer(groups.as_buffer(), dtype=np.int32),
            np.frombuffer(cells.as_buffer(), dtype=np.float64).reshape(-1, width.as_py()),
        )


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A result of driver size as a local relation (through Arrow, so that reading it starts no Python worker)."""
    struct = StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)
    columns = zip(*rows) if rows else [()] * len(arrow)
    arrays = [pa.array(list(c), f.type) for c, f in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), schema=struct)


def map_blocks(df: DataFrame, fn: Callable[[np.ndarray], np.ndarray], column: str = "features") -> DataFrame:
    """Apply a numpy function to each (n, m) block of rows.

    ``fn`` must treat rows alike and return n rows; how rows are cut into blocks is Spark's choice.
    Other columns pass through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield replace_column(batch, column, lists(np.asarray(fn(dense(batch, column)), dtype=float)))

    return df.mapInArrow(run, df.schema)


def to_numpy(df: DataFrame, column: str = "features", max_cells: int = 20_000_000, key: str = "row_id") -> np.ndarray:
    """Collect a small feature table as a matrix, ordered by key; larger tables raise before any transfer."""
    rows, width = df.agg(F.count(F.lit(1)), F.max(F.size(column))).first()
    check_cells(int(rows) * int(width or 0), max_cells, "the table")
    if not rows:
        return np.zeros((0, 0))
    table = df.select(key, column).toArrow().combine_chunks()
    order = np.argsort(table.column(key).to_numpy(), kind="stable")
    return dense(table.to_batches()[0], column)[order]
