"""Exact top-k search by inner product: a KD-tree for each shard, traversed best first."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settle

SHARD_ROWS, BLOCK_QUERIES, LEAF_ROWS = 8192, 4096, 64
NONE = -(2**63)
FOUND = "query_id bigint, vec_id bigint, score bigint"
_SCHEMA = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


class KDTree:
    """Points split at the median of their widest dimension down to leaves; each node keeps the tight box of its points."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF_ROWS) -> None:
        self.order = np.arange(len(points))
        low, high, self.children, self.range = [], [], [], []
        todo = [(0, len(points), -1)]
        while todo:
            start, end, parent = todo.pop()
            node = len(low)
            if parent >= 0:
                self.children[parent].append(node)
            part = points[self.order[start:end]]
            low.append(part.min(axis=0)), high.append(part.max(axis=0))
            self.children.append([]), self.range.append((start, end))
            extent = high[-1] - low[-1] if part.shape[1] else np.zeros(1)
            if end - start > leaf and extent.max() > 0:
                middle = (end - start) // 2
                split = np.argpartition(part[:, int(extent.argmax())], middle)
                self.order[start:end] = self.order[start:end][split]
                todo += [(start, start + middle, node), (start + middle, end, node)]
        self.low, self.high = np.array(low), np.array(high)
        self.points = points[self.order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Largest inner product that each query can have in each node's box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, bounds: np.ndarray, ids: np.ndarray, own: int, k: int, kth: int) -> list[tuple[int, int]]:
        """The best (score, -id) pairs, best first, of points with scores of ``kth`` or more (of another shard's k-th best): boxes in
        order of bound until a bound falls below the k-th score so far. ``ids`` are in tree order; points with the id ``own`` are passed over."""
        best: list[tuple[int, int]] = []  # a heap, the worst on top
        queue = [(-bounds[0], 0)]
        while queue and -queue[0][0] >= kth:
            _, node = heapq.heappop(queue)
            for child in self.children[node]:
                if bounds[child] >= kth:
                    heapq.heappush(queue, (-bounds[child], child))
            if self.children[node]:
                continue
            start, end = self.range[node]
            scores = self.points[start:end] @ query
            for i in np.flatnonzero((scores >= kth) & (ids[start:end] != own)):
                item = (int(scores[i]), -int(ids[start + i]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
                if len(best) == k:
                    kth = max(kth, best[0][0])
        return sorted(best, reverse=True)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _search(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _SCHEMA.empty_table()
        points, queries = _matrix(left.column("v")), _matrix(right.column("v"))
        largest = float(np.abs(points).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(points.shape[1], 1)
        if largest >= 2.0**63:
            raise ValueError("inner products of these components may not fit 64 bits")
        if largest < 2.0**53:  # exact in doubles
            points, queries = points.astype(float), queries.astype(float)
        tree = KDTree(points)
        ids = left.column("vec_id").to_numpy()[tree.order]
        query_ids, kths = right.column("vec_id").to_numpy(), right.column("kth").to_numpy()
        out: list[tuple[int, int, int]] = []
        for at in range(0, len(queries), 512):
            bounds = tree.bounds(queries[at : at + 512])
            for i, bound in enumerate(bounds, at):
                found = tree.search(queries[i], bound, ids, int(query_ids[i]), k, int(kths[i]))
                out += [(int(query_ids[i]), -other, score) for score, other in found]
        columns = list(zip(*out, strict=True)) if out else [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], schema=_SCHEMA)

    return run


def integer_vectors(df: DataFrame, vector: str = "embedding", key: str = "vec_id", factor: float = 1024.0) -> DataFrame:
    """(vec_id, v): floor(factor * x) of every component x. Rows without key, and vectors that are null or hold null or non-finite components, are left out."""
    v = F.col(f"`{vector}`")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = df.where(F.col(f"`{key}`").isNotNull() & v.isNotNull() & fine)
    return rows.select(F.col(f"`{key}`").cast("bigint").alias("vec_id"), F.transform(v, lambda x: F.floor(F.lit(factor) * x.cast("double"))).alias("v"))


def top_inner_products(vectors: DataFrame, is_query: Column, k: int = 10, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for every query of ``vectors`` (vec_id, v) the k rows of highest inner product, ties to the smaller vec_id.

    Rows are dealt to shards by hash. First every query searches its own shard, which gives a k-th score; with this bound it then
    searches all others. A task holds one shard and one block of queries, both of bounded size, whatever the table's size; the queries are
    copied once per shard and the rows once per block. Best rows per query and shard are merged by a window.

    Rows with the query's vec_id are its own and no candidates. A vec_id that is repeated among queries is one query, with its largest vector;
    repeated candidates are rows of their own. Candidates have the query's number of components. Fewer than k candidates: all of them.
    Empty table: empty result. Components so large that a product may not fit 64 bits raise an error.
    """
    vectors = settle(vectors.select("vec_id", "v", F.size("v").alias("d")), "vectors")
    n = max(1, -(-vectors.count() // shard_rows))
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    rows = vectors.withColumn("shard", shard)
    queries = rows.where(is_query).groupBy("vec_id").agg(F.max(F.struct("v", "d", "shard")).alias("q")).select("vec_id", "q.*")
    queries = settle(queries.withColumn("kth", F.lit(NONE)), "queries")
    own = queries.groupBy("d", "shard").cogroup(rows.groupBy("d", "shard")).applyInArrow(lambda q, r: _search(k)(r, q), FOUND)
    if n == 1:
        found = own
    else:
        own = settle(own, "own-shard")
        blocks = max(1, -(-queries.count() // block_queries))
        kth = own.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("reached"))
        wide = queries.drop("kth").join(kth, F.col("vec_id") == F.col("query_id"), "left").withColumn("kth", F.coalesce("reached", F.lit(NONE)))
        wide = wide.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "vec_id"), F.lit(blocks)).cast("int"))
        wide = wide.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).where("to != shard")
        wide = wide.select("vec_id", "v", "kth", "d", F.col("to").alias("shard"), "block")
        copies = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        others = wide.groupBy("d", "shard", "block").cogroup(copies.groupBy("d", "shard", "block")).applyInArrow(lambda q, r: _search(k)(r, q), FOUND)
        found = own.unionByName(others)
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", place.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
