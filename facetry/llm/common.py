"""Helpers shared by the operators: scratch tables, text buffers, hashes of words, and components of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import write_scratch as settle  # noqa: F401  cuts lineage, survives lost executors, computes once

#: Bytes of text that a task turns into numpy arrays at a time.
CHUNK_BYTES = 2 << 20
#: Bytes of ASCII letters (lower-cased), digits and all beyond ASCII stand; others become spaces.
FOLD = bytes(b if chr(b).isascii() and chr(b).isalnum() or b >= 128 else 32 for b in range(256)).lower()


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unit_uniform(*parts: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the given columns and the seed alone: 52 bits of an md5 digest. Null counts as a text of its own."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(2**52))


def binary(column: str) -> Column:
    """Text as UTF-8 bytes for Python tasks; null stays null."""
    return F.col(f"`{column}`").cast("binary")


def text_chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    """The byte strings of an Arrow column (null: empty), in order, in lists of about ``limit`` bytes; a longer one stands alone."""
    chunk, held = [], 0
    for value in texts:
        raw = value.as_py() or b""
        if chunk and held + len(raw) > limit:
            yield chunk
            chunk, held = [], 0
        chunk.append(raw)
        held += len(raw)
    if chunk:
        yield chunk


def _byte_table() -> np.ndarray:
    values = np.arange(256, dtype=np.uint64)
    return mix64(values + np.uint64(0x9E3779B97F4A7C15))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of the argument."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


_PRIME = 0x100000001B3
_INVERSE = pow(_PRIME, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class WordHasher:
    """64-bit hashes of the words of a buffer, vectorised: a polynomial over the bytes from prefix sums, then mixed."""

    def __init__(self) -> None:
        self.bytes_ = _byte_table()
        self.up = self.down = np.ones(0, np.uint64)

    def hashes(self, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.up) <= len(buffer):
            self.up, self.down = _powers(_PRIME, len(buffer) + 1), _powers(_INVERSE, len(buffer) + 1)
        sums = np.zeros(len(buffer) + 1, np.uint64)
        np.cumsum(self.bytes_[buffer] * self.up[: len(buffer)], out=sums[1:])
        return mix64((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def word_spans(chunk: list[bytes], is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of several texts laid end to end: the buffer, starts and ends of runs of word bytes, and each word's text. No run crosses two texts."""
    joined = b"\n".join(chunk) + b"\n"
    buffer = np.frombuffer(joined, np.uint8)
    inside = is_word[buffer]
    offsets = np.cumsum([len(t) + 1 for t in chunk])
    inside[offsets - 1] = False
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    starts, ends = edges[::2], edges[1::2]
    return buffer, starts, ends, np.searchsorted(offsets, starts, side="right")


def whitespace_words() -> np.ndarray:
    """Which bytes belong to words that space and control characters 9 to 13 separate."""
    table = np.ones(256, bool)
    table[[32, *range(9, 14)]] = False
    return table


def bit_filter(keys: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of a table's column ``key`` (64-bit hashes) as 64-bit words of ``2 ** bits`` bits, one size at any number of keys. The driver gets those
    of its words that are not zero."""
    mask = F.lit((1 << bits) - 1)
    places = F.explode(F.array(F.col("key").bitwiseAND(mask), F.shiftrightunsigned("key", 64 - bits).bitwiseAND(mask)))
    words = keys.select(places.alias("place")).select(F.shiftright("place", 6).alias("at"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit"))
    words = words.groupBy("at").agg(F.bit_or("bit").alias("word")).toArrow()
    filled = np.zeros(1 << (bits - 6), np.uint64)
    filled[words.column("at").to_numpy()] = words.column("word").to_numpy().view(np.uint64)
    return filled


def filter_holds(filled: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """Which of some unsigned keys a filter lets pass: all that it was made of, and few others while it is sparse."""
    out = np.ones(len(keys), bool)
    for place in (keys & np.uint64((1 << bits) - 1), keys >> np.uint64(64 - bits)):
        out &= (filled[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0
    return out


def fresh_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores added until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def local_forest(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``size`` nodes over the links a-b."""
    label = np.arange(size)
    while len(a):
        before = label
        label = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(label, before):
            break
        keep = label[a] != label[b]
        if not keep.any():
            break
    while not np.array_equal(label, label[label]):
        label = label[label]
    return label


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the links (a, b), root the smallest node of its component; ``a`` and ``b`` of one comparable type.

    Alternates two steps until the links are stars: every larger neighbour of a node is linked to the smallest of the neighbourhood, then
    every node and its smaller neighbours to the smallest of those. Both keep components, and neither makes more links than nodes and links
    together. A step costs an aggregate and a join of the links, and is written to the scratch folder. Neighbour lists are never gathered: the
    links of a hub are reduced by partial aggregates, and its joins are split by skew handling.
    """
    small, large = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")

    def tidy(df: DataFrame) -> DataFrame:
        return settle(df.where(F.col("a") != F.col("b")).select(small, large).distinct(), "links")

    links = tidy(links)
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("low"))
        links = tidy(links.join(low, F.col("a") == F.col("node")).select(F.col("low").alias("a"), "b"))
        low = links.groupBy("b").agg(F.min("a").alias("low")).select(F.col("b").alias("node"), "low")
        links = tidy(links.join(low, F.col("b") == F.col("node")).select("a", F.col("low").alias("b")).unionByName(low.select(F.col("node").alias("a"), F.col("low").alias("b"))))
        several = links.groupBy("b").count().where("count > 1").isEmpty()
        chained = links.select(F.col("a").alias("b")).distinct().join(links.select("b"), "b", "left_semi").isEmpty()
        if several and chained:
            roots = links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
            return links.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(roots)
    raise RuntimeError(f"links have not settled after {rounds} rounds")
