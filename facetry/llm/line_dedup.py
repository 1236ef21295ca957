"""Near-duplicate lines within an edit distance, by a segment-partition join and banded bit-parallel verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary, components, local_forest, mix64, settle, shuffle_width, text_chunks

#: Edits (insert, delete, replace a character) up to which lines link, and characters from which lines link other than by being equal.
EDITS, MIN_CHARS = 2, 20
#: Rows of one key that a task compares; a larger key is dealt out as pairs of parts.
PART_ROWS = 4096
STEP_PAIRS = 2_000_000
#: Line ids that are broadcast to fetch texts; more are joined.
BROADCAST_IDS = 2_000_000
BINS = 32  # of two bits each in a line's sketch
KEY_BYTES = 6  # kept of a key: equal keys of different segments only add candidates, which sketches and texts refuse


def segments(length: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size, lines x (edits + 1), of the nearly equal segments that a line of a length is split into."""
    parts = np.arange(edits + 2)
    cuts = length[:, None] * parts // (edits + 1)
    return cuts[:, :-1], np.diff(cuts, axis=1)


def probes(edits: int) -> list[tuple[int, int, int]]:
    """(how much shorter the other line is, segment, shift): all substrings of a line that can equal a segment of a line of its length or up to ``edits`` less.

    Of two lines within ``edits``, one segment i matches with at most i edits before and edits - i after it, so its shift is at most i from the
    left and differs from the length gap by at most edits - i from the right.
    """
    out = []
    for shorter in range(edits + 1):
        for i in range(edits + 1):
            low = max(-i, shorter - (edits - i))
            high = min(i, shorter + (edits - i))
            out += [(shorter, i, shift) for shift in range(low, high + 1)]
    return out


class LineKeys:
    """Keys of the segments and substrings of lines, from prefix sums of a polynomial over their characters."""

    PRIME, INVERSE = 0x100000001B3, pow(0x100000001B3, -1, 2**64)

    def __init__(self, edits: int = EDITS, min_chars: int = MIN_CHARS) -> None:
        self.edits, self.min_chars, self.probes = edits, max(min_chars, edits + 1), probes(edits)
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) <= n:
            for name, base in (("up", self.PRIME), ("down", self.INVERSE)):
                row = np.full(n + 1, base, np.uint64)
                row[0] = 1
                setattr(self, name, np.multiply.accumulate(row))

    def _sums(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        length = np.array([len(x) for x in lines], np.int64)
        points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self._grow(len(points))
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(mix64(points + np.uint64(0x51ED270B)) * self.up[: len(points)], out=sums[1:])
        return points, length, np.cumsum(length) - length, sums

    def _ids(self, length: np.ndarray, starts: np.ndarray, sums: np.ndarray) -> np.ndarray:
        whole = (sums[starts + length] - sums[starts]) * self.down[starts]
        return mix64(whole + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def ids(self, lines: list[str]) -> np.ndarray:
        return self._ids(*self._sums(lines)[1:])

    @staticmethod
    def split(chunk: list[bytes]) -> tuple[list[int], list[int], list[str]]:
        """Text index, line number and text of all lines with a character; their outer whitespace is cut."""
        text, number, lines = [], [], []
        for i, raw in enumerate(chunk):
            for j, line in enumerate(raw.decode("utf-8", "replace").split("\n")):
                if line := line.strip():
                    text.append(i), number.append(j), lines.append(line)
        return text, number, lines

    def keys(self, lines: list[str]):
        """(id, length, sketch, index keys, probe keys) of lines. Keys of lines below ``min_chars`` are not made (their rows of keys are not
        to be used)."""
        points, length, starts, sums = self._sums(lines)

        def piece(at: np.ndarray, size: np.ndarray) -> np.ndarray:
            return (sums[at + size] - sums[at]) * self.down[at]

        ids = self._ids(length, starts, sums)
        owner = np.repeat(np.arange(len(lines)), length)
        bins = (mix64(points) >> np.uint64(59)).astype(np.int64)
        counts = np.bincount(owner * BINS + bins, minlength=len(lines) * BINS).reshape(-1, BINS)
        sketch = ((counts & 3).astype(np.uint64) << (2 * np.arange(BINS, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)

        def key(at: np.ndarray, size: np.ndarray, of_length: np.ndarray, i: int) -> np.ndarray:
            return mix64(mix64(piece(at, size) + np.uint64(i)) + of_length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

        use = np.flatnonzero(length >= self.min_chars)
        begin, full = starts[use], length[use]
        cut, size = segments(full, self.edits)
        index = np.zeros((len(lines), self.edits + 1), np.uint64)
        probe = np.zeros((len(lines), len(self.probes)), np.uint64)
        for i in range(self.edits + 1):
            index[use, i] = key(begin + cut[:, i], size[:, i], full, i)
        for n, (shorter, i, shift) in enumerate(self.probes):
            cut, size = segments(full - shorter, self.edits)
            at = np.clip(cut[:, i] + shift, 0, full - size[:, i])
            probe[use, n] = key(begin + at, size[:, i], full - shorter, i)
        return ids, length, sketch, index, probe


def sketch_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A lower bound of the characters that two lines do not share: circular differences of counts modulo 4, summed over bins. An edit adds at most 2."""
    low, high = np.uint64(0x5555555555555555), np.uint64(0xAAAAAAAAAAAAAAAA)
    x, y = a | high, b & ~high  # subtract within two-bit fields: no borrow leaves a field
    d = (x - y) ^ ((a ^ ~b) & high)
    odd = d & low
    two = (d >> np.uint64(1)) & low & ~odd
    return np.bitwise_count(odd).astype(np.int64) + 2 * np.bitwise_count(two).astype(np.int64)


def _plain_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        left, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(left[j + 1] + 1, row[-1] + 1, left[j] + (x != y)))
    return row[-1]


def banded_distance(pairs: list[tuple[str, str]], edits: int) -> np.ndarray:
    """Edit distance of each pair, edits + 1 standing for all above: Hyyrö's bit-parallel recurrence on a diagonal band of 2 edits + 1
    bits, one column of all pairs at a time."""
    over = edits + 1
    out = np.full(len(pairs), over, np.int64)
    sided = [(a, b) if len(a) >= len(b) else (b, a) for a, b in pairs]
    for i, (a, b) in enumerate(sided):
        if len(a) <= edits:  # shorter than the band
            out[i] = min(over, _plain_distance(a, b))
    close = [i for i, (a, b) in enumerate(sided) if len(a) - len(b) <= edits < len(a)]
    close.sort(key=lambda i: -len(sided[i][1]))
    if not close:
        return out
    m = np.array([len(sided[i][0]) for i in close])
    n = np.array([len(sided[i][1]) for i in close])
    pad = [np.frombuffer("".join(sided[i][s] for i in close).encode("utf-32-le", "surrogatepass"), np.uint32) for s in (0, 1)]
    pad[0] = np.append(pad[0], np.zeros(edits + 1, np.uint32))
    at = [np.cumsum(x) - x for x in (m, n)]
    one = np.uint64(1)
    vp = np.full(len(close), (2**64 - 1) << (63 - edits) & (2**64 - 1), np.uint64)
    vn = np.zeros(len(close), np.uint64)
    score = np.full(len(close), edits, np.int64)
    top = np.uint64(1 << 63)
    active = len(close)
    for j in range(int(n[0])):
        while active and n[active - 1] <= j:
            active = int(np.searchsorted(-n, -j, "left"))
        k = slice(0, active)
        c = pad[1][at[1][k] + j]
        eq = np.zeros(active, np.uint64)
        for offset in range(-edits, edits + 1):
            row = j + offset
            if row >= 0:
                same = (row < m[k]) & (pad[0][np.minimum(at[0][k] + row, len(pad[0]) - 1)] == c)
                eq |= same.astype(np.uint64) << np.uint64(63 - edits + offset)
        p, q = vp[k], vn[k]
        d0 = (((eq & p) + p) ^ p) | eq | q
        hp, hn = q | ~(d0 | p), d0 & p
        last = j - (m[k] - edits)  # from here on the band's last row is the pattern's, one bit lower with each column
        diagonal = last < 0
        bit = one << (62 - np.clip(last, 0, 62)).astype(np.uint64)
        score[k] += np.where(diagonal, (d0 & top) == 0, ((hp & bit) > 0).astype(np.int64) - ((hn & bit) > 0))
        vp[k] = hn | ~((d0 >> one) | hp)
        vn[k] = (d0 >> one) & hp
    out[close] = np.minimum(score, over)
    return out


def _emit(make: LineKeys, with_keys: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at = batch.column(0), 0
            for chunk in text_chunks(batch.column(1)):
                own = keys.slice(at, len(chunk))
                at += len(chunk)
                text, number, lines = make.split(chunk)
                if with_keys:
                    ids, length, sketch, index, probe = make.keys(lines)
                    first = np.unique(ids, return_index=True)[1]
                    first = first[length[first] >= make.min_chars]
                    both = np.hstack([index[first], probe[first]])
                    short = both.view(np.uint8).reshape(*both.shape, 8)[:, :, :KEY_BYTES].reshape(len(first), both.shape[1] * KEY_BYTES)
                    packed = np.hstack([sketch[first, None].view(np.uint8), short])
                    rows = [pa.array(ids[first].view(np.int64)), pa.array([r.tobytes() for r in packed], pa.binary())]
                    yield pa.RecordBatch.from_arrays(rows, names=["id", "packed"])
                else:
                    rows = [own.take(pa.array(text, pa.int64())), pa.array(number, pa.int32()), pa.array(make.ids(lines).view(np.int64))]
                    yield pa.RecordBatch.from_arrays(rows, names=["key", "line_no", "id"])

    return run


def _unpack(edits: int):
    width = edits + 1 + len(probes(edits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                raw = np.frombuffer(b"".join(v.as_py() for v in part.column(1)), np.uint8).reshape(len(ids), 8 + width * KEY_BYTES)
                keys = np.zeros((len(ids), width, 8), np.uint8)
                keys[:, :, :KEY_BYTES] = raw[:, 8:].reshape(len(ids), width, KEY_BYTES)
                indexed = np.broadcast_to(np.arange(width) <= edits, (len(ids), width))
                columns = [
                    pa.array(keys.view(np.int64).ravel()),
                    pa.array(np.repeat(ids, width)),
                    pa.array(np.repeat(np.ascontiguousarray(raw[:, :8]).view(np.int64).ravel(), width)),
                    pa.array(indexed.ravel()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["k", "id", "sketch", "indexed"])

    return run


def candidate_pairs(key: np.ndarray, ids: np.ndarray, sketch: np.ndarray, indexed: np.ndarray, edits: int, reduce: bool):
    """(key, a, b, complete) for lines that share a key, one as index and one as probe, and whose sketches allow ``edits``.

    Where a key has more than twice as many pairs as rows and ``reduce`` is set, a forest of them stands for all, marked as not complete.
    """
    bounds = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    size = np.diff(bounds)
    run = np.repeat(np.arange(len(size)), size)
    own = np.flatnonzero(indexed)
    first, counts = bounds[run[own]], size[run[own]]
    total, at, out = np.cumsum(counts), 0, []
    while at < len(own):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + STEP_PAIRS, side="right")))
        some = counts[at:to]
        a = np.repeat(own[at:to], some)
        b = np.arange(len(a)) - np.repeat(np.cumsum(some) - some, some) + np.repeat(first[at:to], some)
        keep = ~indexed[b]
        a, b = a[keep], b[keep]
        keep = ids[a] != ids[b]
        a, b = a[keep], b[keep]
        keep = sketch_distance(sketch[a].view(np.uint64), sketch[b].view(np.uint64)) <= 2 * edits
        a, b = a[keep], b[keep]
        # Rows of one line in a group are one node.
        nodes, index = np.unique(np.stack([np.concatenate([run[a], run[b]]), np.concatenate([ids[a], ids[b]])]), axis=1, return_inverse=True)
        x, y = index[: len(a)], index[len(a) :]
        x, y = np.minimum(x, y), np.maximum(x, y)
        x, y = np.unique(np.stack([x, y]), axis=1)
        many = np.bincount(nodes[0][x], minlength=len(size)) > 2 * size if reduce else np.zeros(len(size), bool)
        dense = many[nodes[0][x]]
        label = local_forest(nodes.shape[1], x[dense], y[dense])
        moved = np.flatnonzero(label != np.arange(len(label)))
        for p, q, complete in ((x[~dense], y[~dense], True), (label[moved], moved, False)):
            k = key[bounds[nodes[0][p]]]
            out.append((k, np.minimum(nodes[1][p], nodes[1][q]), np.maximum(nodes[1][p], nodes[1][q]), np.full(len(p), complete)))
        at = to
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (empty, empty, empty, np.zeros(0, bool))


def _pairs(edits: int, reduce: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        for batch in batches:
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            rows = [np.concatenate(x) for x in zip(kept, rows, strict=True)] if kept else rows
            if not len(rows[0]):
                continue
            earlier = np.flatnonzero(np.any([x != x[-1] for x in rows[:3]], axis=0))
            end = int(earlier[-1]) + 1 if len(earlier) else 0
            yield pairs([x[:end] for x in rows])
            kept = [x[end:] for x in rows]
        if kept:
            yield pairs(kept)

    def pairs(rows: list[np.ndarray]) -> pa.RecordBatch:
        group = np.cumsum(np.any([np.diff(x, prepend=x[:1]) != 0 for x in rows[:3]], axis=0))
        g, a, b, complete = candidate_pairs(group, *rows[3:], edits, reduce)
        first = np.searchsorted(group, g)
        return pa.RecordBatch.from_arrays([pa.array(rows[0][first]), pa.array(a), pa.array(b), pa.array(complete)], names=["k", "a", "b", "complete"])

    return run


def _verify(edits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                texts = list(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True))
                near = banded_distance(texts, edits) <= edits
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(near)], names=["a", "b", "near"])

    return run


class LineJoin:
    """The steps of the join over one table; ``links`` gives pairs of line ids that connect all lines within the distance."""

    def __init__(self, docs: DataFrame, key: str, text: str, edits: int, min_chars: int) -> None:
        self.edits, self.make = edits, LineKeys(edits, min_chars)
        self.docs = docs.select(F.col(f"`{key}`").alias("key"), binary(text).alias("text"))
        self.width = shuffle_width(docs.sparkSession)
        kind = self.docs.schema["key"].dataType.simpleString()
        self.occurrences = self.docs.mapInArrow(_emit(self.make, False), f"key {kind}, line_no int, id bigint")

    def rows(self) -> DataFrame:
        """One row per key of every distinct line; a line's rows do not grow with its copies."""
        packed = self.docs.mapInArrow(_emit(self.make, True), "id bigint, packed binary")
        # Written once: the rows are read to find hot keys, to make pairs, and again where a forest fails.
        distinct = settle(packed.groupBy("id").agg(F.first("packed").alias("packed")), "distinct-lines")
        return distinct.mapInArrow(_unpack(self.edits), "k bigint, id bigint, sketch bigint, indexed boolean")

    def pairs(self, rows: DataFrame, reduce: bool) -> DataFrame:
        rows = rows.repartition(self.width, "k", "i", "j").sortWithinPartitions("k", "i", "j")
        return rows.mapInArrow(_pairs(self.edits, reduce), "k bigint, a bigint, b bigint, complete boolean")

    def dealt(self, rows: DataFrame) -> DataFrame:
        """Rows with parts (i, j): (0, 0) for most keys; a key with too many rows as all pairs of its parts."""
        sizes = rows.groupBy("k").count().where(F.col("count") > PART_ROWS)
        hot = settle(sizes.select("k", F.ceil(F.col("count") / (PART_ROWS // 2)).cast("int").alias("parts")), "hot-keys")
        columns = ("k", "i", "j", "id", "sketch", "indexed")
        if hot.isEmpty():
            return rows.withColumn("i", F.lit(0)).withColumn("j", F.lit(0)).select(*columns)
        cold = rows.join(hot, "k", "left_anti").withColumn("i", F.lit(0)).withColumn("j", F.lit(0)).select(*columns)
        many = rows.join(hot, "k").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        many = many.withColumn("i", F.least("part", "other") + 1).withColumn("j", F.greatest("part", "other") + 1)
        return cold.unionByName(many.select(*columns))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """(a, b, near) of distinct pairs, from the lines' texts."""
        pairs = settle(pairs.select("a", "b").distinct(), "line-pairs")
        ids = settle(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "line-ids")
        lines = self.docs.mapInArrow(_texts(self.make), "id bigint, line string")
        wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        texts = settle(lines.join(wanted, "id", "left_semi").groupBy("id").agg(F.first("line").alias("line")), "lines")
        both = pairs.join(texts.withColumnRenamed("id", "a").withColumnRenamed("line", "x"), "a").join(texts.withColumnRenamed("id", "b").withColumnRenamed("line", "y"), "b")
        return settle(both.select("a", "b", "x", "y").mapInArrow(_verify(self.edits), "a bigint, b bigint, near boolean"), "verified")

    def links(self) -> DataFrame:
        rows = self.dealt(self.rows())
        pairs = settle(self.pairs(rows, True), "pairs")
        verified = self.verified(pairs)
        links = verified.where("near").select("a", "b")
        # A forest stands for all pairs of a key only if all its links are near; the keys of others give all their pairs.
        broken = pairs.where(~F.col("complete")).join(verified.where(~F.col("near")), ["a", "b"], "left_semi").select("k").distinct()
        broken = settle(broken, "broken")
        if not broken.isEmpty():
            again = self.verified(self.pairs(rows.join(broken, "k", "left_semi"), False))
            links = links.unionByName(again.where("near").select("a", "b"))
        return links


def _texts(make: LineKeys):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch.column(1)):
                lines = make.split(chunk)[2]
                yield pa.RecordBatch.from_arrays([pa.array(make.ids(lines).view(np.int64)), pa.array(lines, pa.string())], names=["id", "line"])

    return run


def line_classes(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, class_key, class_line_no, kept) for every line of ``docs`` that holds more than whitespace; line numbers count from 0.

    Lines link if they are equal, or if both have ``min_chars`` characters and differ by at most ``edits`` edits; outer whitespace does not count. A
    class is what links connect, named by its smallest (key, line number); that line is kept, the others repeat it.

    Of lines within e edits one of e + 1 segments is equal, at a place that lengths and segment number confine: 3 index and 13 probe keys per distinct
    line for 2 edits. Lines meet per key; sketches of their characters drop pairs that cannot be near, and the rest is verified on
    the texts. No more pairs of a key are written than twice its rows: dense groups give a forest, and all pairs only where a link of
    the forest fails. Nothing is dropped: very frequent keys are dealt out as pairs of parts. Lines are told apart by 64-bit hashes.

    Null or empty texts have no lines. A null key is a value of its own, before all others. Rows that share a key share its line numbers; of equal
    (key, line number) in one class all are kept. An empty table gives an empty result. Other columns are not looked at.
    """
    join = LineJoin(docs, key, text, edits, min_chars)
    roots = components(join.links())
    rows = join.occurrences.join(roots, F.col("id") == F.col("node"), "left")
    rows = settle(rows.select("key", "line_no", F.coalesce("root", "id").alias("root")), "line-roots")
    first = rows.groupBy("root").agg(F.min(F.struct("key", "line_no")).alias("first"))
    found = rows.join(first, "root")
    same = F.col("key").eqNullSafe(F.col("first.key")) & (F.col("line_no") == F.col("first.line_no"))
    return found.select(
        F.col("key").alias(key), "line_no", F.col("first.key").alias(f"class_{key}"), F.col("first.line_no").alias("class_line_no"), same.alias("kept")
    )


def without_lines(text: Column, numbers: Column) -> Column:
    """A text without the lines of the given numbers (an array; null: none)."""
    lines = F.split(text, "\n")
    numbered = F.transform(lines, lambda line, i: F.struct(i.alias("i"), line.alias("line")))
    left = F.filter(numbered, lambda x: ~F.array_contains(F.coalesce(numbers, F.array().cast("array<int>")), x["i"]))
    return F.array_join(F.transform(left, lambda x: x["line"]), "\n")


def dedup_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with every line that repeats an earlier one cut from its text; all columns kept. A document may end up empty."""
    found = line_classes(docs, edits, min_chars, key, text).where(~F.col("kept"))
    gone = found.groupBy(F.col(f"`{key}`").alias("__key")).agg(F.collect_set("line_no").alias("__gone"))
    joined = docs.join(gone, F.col(f"`{key}`").eqNullSafe(F.col("__key")), "left")
    return joined.withColumn(text, without_lines(F.col(f"`{text}`"), F.col("__gone"))).drop("__key", "__gone")
