"""One-to-one matching of very many classes: an auction over the pairs of classes that occur.

Maximises the summed benefit of a matching in which classes of either side may stay single. For every class there is a stand-in on the other side:
the stand-in of an object can be matched with the object (it stays single), or with the stand-in of any class that the object occurs with. So a
perfect matching always exists and holds the one looked for, which is what lets prices of one scale start the next.

The pairs lie in Spark, packed in blocks; what the driver holds are a price and an owner for each class, checked. A round is one map: every block
gives, for those of its classes that are unmatched, the best and the second best offer at the current prices. Up to LOCAL_PAIRS pairs the blocks are
fetched, and rounds, of which there may be many thousands while the last few classes displace each other, need no Spark job.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import check_cells

MAX_CLASSES = 20_000_000
SCALE = 5.0  # by which the least raise of a bid falls from one scale to the next
BLOCK_PAIRS = 1_000_000
LOCAL_PAIRS = 20_000_000  # pairs that occur, up to which the rounds need no Spark job
FEW = 64  # free bidders from which on they bid one by one
BIDS = "bidder int, item int, best double, second double"


@dataclass
class Matching:
    """Positions: ``partner[i]`` is the column of row i, or -1. ``gap`` bounds how far the summed benefit lies below the optimum."""

    rows: np.ndarray
    columns: np.ndarray
    partner: np.ndarray
    benefit: float
    gap: float
    rounds: int


def _labels(counts: DataFrame, name: str, limit: int) -> np.ndarray:
    found = counts.select(name).distinct().limit(limit + 1).toArrow().column(name).to_numpy()
    check_cells(len(found), limit, "the list of classes")
    return np.sort(found)


def _packed_pairs(counts: DataFrame, rows: np.ndarray, columns: np.ndarray, benefit: str, block_pairs: int) -> DataFrame:
    """Blocks of (bidder, item, value), ordered by bidder: for each pair that occurs that of the classes and that of their stand-ins.

    Bidders: rows, then stand-ins of columns. Items: columns, then stand-ins of rows. A bidder with very many pairs may lie in several blocks.
    """
    t, p = len(rows), len(columns)
    ends = counts.sparkSession.sparkContext.broadcast((rows, columns))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, columns = ends.value
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def send() -> pa.RecordBatch:
            i, j, b = (np.concatenate(x) for x in zip(*held, strict=True))
            bidder, item = np.concatenate([i, t + j]).astype(np.int32), np.concatenate([j, p + i]).astype(np.int32)
            value = np.concatenate([b, np.zeros(len(b))])
            order = np.argsort(bidder, kind="stable")
            raw = [pa.array([x[order].tobytes()], pa.binary()) for x in (bidder, item, value)]
            return pa.RecordBatch.from_arrays(raw, names=["bidder", "item", "value"])

        for batch in batches:
            i = np.searchsorted(rows, batch.column("true_label").to_numpy())
            j = np.searchsorted(columns, batch.column("pred_label").to_numpy())
            held.append((i, j, batch.column("benefit").to_numpy()))
            size += len(i)
            if size >= block_pairs:
                yield send()
                held, size = [], 0
        if size:
            yield send()

    pairs = counts.select("true_label", "pred_label", F.expr(benefit).cast("double").alias("benefit")).where("benefit > 0")
    return pairs.mapInArrow(pack, "bidder binary, item binary, value binary")


def _block_bids(bidder: np.ndarray, item: np.ndarray, value: np.ndarray, price: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, ...]:
    """(bidder, item, best, second) for every free bidder of one block: its best offer there and the value of the next best, -inf if there is none."""
    open_ = free[bidder]
    bidder, item = bidder[open_], item[open_]
    net = value[open_] - price[item]
    order = np.lexsort((item, -net, bidder))
    bidder, item, net = bidder[order], item[order], net[order]
    first = np.flatnonzero(np.diff(bidder, prepend=-1))
    after = np.minimum(first + 1, len(bidder) - 1)
    has = (first + 1 < len(bidder)) & (bidder[after] == bidder[first])
    return bidder[first], item[first], net[first], np.where(has, net[after], -np.inf)


def _arrays_of(batch: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
    for raw in zip(*(batch.column(c) for c in ("bidder", "item", "value")), strict=True):
        yield [np.frombuffer(x.as_buffer(), kind) for x, kind in zip(raw, (np.int32, np.int32, np.float64), strict=True)]


class _Market:
    """Prices and owners of the items of one auction, and what a scale does to them. ``blocks``: packed pairs in Spark, or all pairs here."""

    def __init__(self, blocks: DataFrame | list[list[np.ndarray]], own: np.ndarray, max_rounds: int) -> None:
        self.blocks, self.own, self.n, self.left, self.rounds = blocks, own, len(own), max_rounds, 0
        self.price = np.zeros(self.n)
        self.local = isinstance(blocks, list)
        if self.local:
            parts = [np.concatenate([*x, extra]) for x, extra in zip(zip(*blocks, strict=True), (np.arange(self.n), own, np.zeros(self.n)), strict=True)] if blocks else [np.arange(self.n), own, np.zeros(self.n)]
            order = np.argsort(parts[0], kind="stable")
            self.bidder, self.item, self.value = (x[order] for x in parts)
            self.starts = np.searchsorted(self.bidder, np.arange(self.n + 1))

    def offers(self, bidders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, best, second) of each of some bidders at current prices; the second is -inf where a bidder has one item."""
        free = np.zeros(self.n, bool)
        free[bidders] = True
        if self.local:
            return _block_bids(self.bidder, self.item, self.value, self.price, free)[1:]
        return _merged(_bids(self.blocks, self.price, free), self.own, self.price, bidders)

    def settle(self, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(owner of each item, item of each bidder) once all are matched: all free bidders bid at once, the last few of a local table one by one."""
        owner, held = np.full(self.n, -1), np.full(self.n, -1)
        while True:
            bidders = np.flatnonzero(held < 0)
            if not len(bidders):
                return owner, held
            if self.local and len(bidders) <= FEW:
                self._one_by_one(bidders.tolist(), owner, held, least)
                continue
            self._round()
            item, best, second = self.offers(bidders)
            offer = self.price[item] + np.where(np.isfinite(second), best - second, 0.0) + least
            order = np.lexsort((bidders, -offer, item))
            wins = order[np.flatnonzero(np.diff(item[order], prepend=-1))]
            taken = item[wins]
            gone = owner[taken]
            held[gone[gone >= 0]] = -1
            owner[taken], held[bidders[wins]] = bidders[wins], taken
            self.price[taken] = offer[wins]

    def _one_by_one(self, waiting: list[int], owner: np.ndarray, held: np.ndarray, least: float) -> None:
        while waiting:
            self._round()
            bidder = waiting.pop()
            pairs = slice(self.starts[bidder], self.starts[bidder + 1])
            items = self.item[pairs]
            net = self.value[pairs] - self.price[items]
            at = int(net.argmax())
            best, net[at] = net[at], -np.inf
            second = net.max()
            item = items[at]
            self.price[item] += (best - second if second > -np.inf else 0.0) + least
            if owner[item] >= 0:
                held[owner[item]] = -1
                waiting.append(int(owner[item]))
            owner[item], held[bidder] = bidder, item

    def _round(self) -> None:
        self.rounds += 1
        if self.rounds > self.left:
            raise ArithmeticError(f"the auction has not ended after {self.left} rounds")


def _bids(blocks: DataFrame, price: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, ...]:
    """The bids of all blocks, made where the blocks lie. Bidders and items are those of ``_packed_pairs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _arrays_of(batch):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _block_bids(*block, price, free)], names=["bidder", "item", "best", "second"])

    found = blocks.mapInArrow(run, BIDS).toArrow()
    return tuple(found.column(c).to_numpy() for c in ("bidder", "item", "best", "second"))


def _merged(found: tuple[np.ndarray, ...], own: np.ndarray, price: np.ndarray, bidders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, best, second) for each of ``bidders``, from the blocks' bids and from the bidder's own stand-in, whose value is 0."""
    bidder = np.concatenate([found[0], bidders])
    item = np.concatenate([found[1], own[bidders]])
    best = np.concatenate([found[2], -price[own[bidders]]])
    second = np.concatenate([found[3], np.full(len(bidders), -np.inf)])
    order = np.lexsort((item, -best, bidder))
    bidder, item, best, second = bidder[order], item[order], best[order], second[order]
    first = np.flatnonzero(np.diff(bidder, prepend=-1))
    rival = np.maximum.reduceat(second, first)  # the seconds of all blocks
    after = first + 1
    has = (after < len(bidder)) & (bidder[np.minimum(after, len(bidder) - 1)] == bidder[first])
    rival = np.maximum(rival, np.where(has, best[np.minimum(after, len(bidder) - 1)], -np.inf))
    return item[first], best[first], rival


def auction(
    counts: DataFrame, benefit: str = "n", tolerance: float = 1e-9, max_classes: int = MAX_CLASSES, max_rounds: int = 100_000_000, block_pairs: int = BLOCK_PAIRS, local_pairs: int = LOCAL_PAIRS
) -> Matching:
    """The matching of classes that maximises the summed ``benefit`` (an SQL expression, not negative) of a table of pairs (each once).

    Bertsekas' auction: unmatched classes bid for what is worth most to them at current prices, raising its price by their lead over the second best plus a least
    raise. This raise falls by ``SCALE`` from one scale to the next, down to ``tolerance`` times the largest benefit; the prices stay, the matching
    starts anew. In the end the sum lies below the optimum by the last raise for every class at most; ``gap`` is what the prices themselves
    prove, by duality, and mostly zero but for rounding. Ties: the smaller position. An empty table gives an empty matching.
    """
    rows, columns = _labels(counts, "true_label", max_classes), _labels(counts, "pred_label", max_classes)
    t, p = len(rows), len(columns)
    if not t:
        return Matching(rows, columns, np.zeros(0, np.int64), 0.0, 0.0, 0)
    n = t + p
    own = np.concatenate([p + np.arange(t), np.arange(p)])  # a row's stand-in, or the column that a bidder stands in for
    packed = _packed_pairs(counts, rows, columns, benefit, block_pairs).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        pairs, largest = counts.agg(F.count("*"), F.max(F.expr(benefit))).first()
        largest = float(largest) or 1.0
        blocks = packed if pairs > local_pairs else [block for batch in packed.toArrow().to_batches() for block in _arrays_of(batch)]
        last, least = tolerance * largest, largest / 4
        market = _Market(blocks, own, max_rounds)
        _, held = market.settle(max(least, last))
        while least > last:
            least /= SCALE
            _, held = market.settle(max(least, last))
        _, best, _ = market.offers(np.arange(n))
        dual = float(best.sum() + market.price.sum())
        partner = np.where(held[:t] < p, held[:t], -1)
        matched = _values(counts, rows, columns, partner, benefit)
    finally:
        packed.unpersist()
    return Matching(rows, columns, partner, matched, max(0.0, dual - matched), market.rounds)


def partner_table(counts: DataFrame, rows: np.ndarray, columns: np.ndarray, partner: np.ndarray) -> DataFrame:
    """``true_label, pred_label`` of matched positions, as a table (through Arrow)."""
    kind = counts.schema["true_label"].dataType.simpleString(), counts.schema["pred_label"].dataType.simpleString()
    at = np.flatnonzero(partner >= 0)
    pairs = pa.table({"true_label": rows[at], "pred_label": columns[partner[at]]})
    return counts.sparkSession.createDataFrame(pairs, f"true_label {kind[0]}, pred_label {kind[1]}")


def _values(counts: DataFrame, rows: np.ndarray, columns: np.ndarray, partner: np.ndarray, benefit: str) -> float:
    pairs = partner_table(counts, rows, columns, partner)
    return float(counts.join(pairs, ["true_label", "pred_label"], "left_semi").agg(F.sum(F.expr(benefit))).first()[0] or 0.0)
