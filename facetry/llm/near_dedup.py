"""Near-duplicate documents: by SimHash fingerprints, compared at the anchor points of a covering code, alone or before an exact check of word shingles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHasher, binary, bit_filter, components, filter_holds, fresh_name, local_forest, mix64, settle, shuffle_width, text_chunks, whitespace_words, word_spans

#: Differing bits up to which fingerprints link.
THRESHOLD = 4
#: Rows of one anchor that a task compares; a larger anchor is dealt out as pairs of parts.
PART_ROWS = 4096
#: Comparisons made at a time.
STEP_PAIRS = 2_000_000
#: (first bit, bits after the first 15) of the blocks. Of 4 differing bits in 3 blocks, one block has at most 1.
BLOCKS = ((0, 6), (21, 6), (42, 7))
#: Words of a shingle and Jaccard similarity of two documents' shingles from which on they link by similarity.
WIDTH, SIMILARITY = 5, 0.8
#: Minima of a band, and the chance that a pair of just the least similarity shares no band.
BAND_ROWS, MISS = 6, 1e-4
#: Members of a band that the others meet as joined pairs, round by round, before all that are still apart meet within tasks: the most central one (further
#: rounds draw theirs at random). Pairs are members x hubs, which in a band of up to so many members as hubs are all its pairs.
STAR_HUBS = (1,)
#: Shingles of the members of a band that a task compares; a larger band is dealt out as pairs of parts.
PART_SHINGLES = 1 << 20
#: log2 of the bits of the filter by which texts that share no band are left out before they are shuffled.
TEXT_FILTER_BITS = 26
_WORDS = whitespace_words()


def fingerprint(raw: bytes, width: int = 4, seed: int = 42, step: int = 1 << 20) -> int:
    """SimHash of a text: bits set in over half of the XXH64 of its shingles of ``width`` words (A-Z lower-cased; ASCII whitespace separates).

    Shingles count as often as they occur; fewer words are one shingle; no words give 0.
    """
    words = raw.lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    ends = ends[min(width, len(words)) - 1 :]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, step):
        spans = zip(starts[at : at + step][: n - at].tolist(), ends[at : at + step].tolist(), strict=True)
        hashes = np.array([digest(text[s:e], seed) for s, e in spans], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, name: str, text: str = "text") -> DataFrame:
    """The table with a column of fingerprints as (signed) long."""

    @F.arrow_udf("bigint")
    def fingerprints(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t.as_py() or b"") for t in texts], np.uint64).view(np.int64))

    return docs.withColumn(name, fingerprints(binary(text)))


def _code() -> tuple[np.ndarray, np.ndarray]:
    """The Hamming code of 15 bits as covering code of radius 1: each word's anchor, and the anchors within 2 (repeats where fewer than 8)."""
    words = np.arange(1 << 15)
    syndrome = np.zeros_like(words)
    for i in range(15):
        syndrome ^= np.where(words >> i & 1, i + 1, 0)
    anchor = np.where(syndrome > 0, words ^ (1 << np.maximum(syndrome - 1, 0)), words)
    around = np.sort(np.stack([anchor] + [anchor[words ^ (1 << i)] for i in range(15)], axis=1), axis=1)
    distinct = np.concatenate([np.ones((len(words), 1), bool), np.diff(around, axis=1) > 0], axis=1)
    near = np.repeat(anchor[:, None], 8, axis=1)
    place = np.cumsum(distinct, axis=1) - 1
    rows, cols = np.nonzero(distinct)
    near[rows, place[rows, cols]] = around[rows, cols]
    return anchor, near


def anchor_rows(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, index of the fingerprint, home) of all copies: in each block a fingerprint's home is the anchor that covers it (first 15 bits within
    1 of a code word, the others equal); copies go to every anchor that can be home of a fingerprint with at most 1 other bit in this block."""
    anchor, near = _code()
    fps = fps.view(np.uint64)
    keys, rows, homes = [], [], []
    index = np.arange(len(fps))
    for number, (first, more) in enumerate(BLOCKS):
        block = ((fps >> np.uint64(first)) & np.uint64((1 << (15 + more)) - 1)).astype(np.int64)
        coded, plain = block & 0x7FFF, block >> 15
        base = (np.int64(number) << 40) | (plain << 15)
        home = base | anchor[coded]
        others = [base | near[coded, i] for i in range(8)] + [home ^ (np.int64(1) << (15 + i)) for i in range(more)]
        keys.append(home), rows.append(index), homes.append(np.ones(len(fps), bool))
        for i, key in enumerate(others):
            keep = key != home
            if 0 < i < 8:
                keep &= near[coded, i] != near[coded, i - 1]
            keys.append(key[keep]), rows.append(index[keep]), homes.append(np.zeros(int(keep.sum()), bool))
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(homes)


def _replicas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(fps), 20_000):
            part = fps[at : at + 20_000]
            keys, rows, home = anchor_rows(part)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows]), pa.array(home)], names=["anchor", "fp", "home"])


def forest(key: np.ndarray, fps: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what lies within the threshold in each run of equal keys: home rows against all rows of the run, and of the links found in
    a step no more than a forest, so that a group of n near copies gives about n links and not all pairs."""
    bounds = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    run = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    own = np.flatnonzero(home)
    first, size = bounds[run[own]], np.diff(bounds)[run[own]]
    out_a, out_b, at, total = [], [], 0, np.cumsum(size)
    while at < len(own):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + STEP_PAIRS, side="right")))
        counts = size[at:to]
        a = np.repeat(own[at:to], counts)
        b = np.arange(len(a)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first[at:to], counts)
        hit = np.bitwise_count(fps[a].view(np.uint64) ^ fps[b].view(np.uint64)) <= threshold
        a, b = a[hit], b[hit]
        nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = nodes[local_forest(len(nodes), index[: len(a)], index[len(a) :])]
        moved = label != nodes
        out_a.append(fps[nodes[moved]]), out_b.append(fps[label[moved]])
        at = to
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (fps[:0], fps[:0])


def _compare(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        for batch in batches:
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            rows = [np.concatenate(x) for x in zip(kept, rows, strict=True)] if kept else rows
            if not len(rows[0]):
                continue
            # The last group may go on in the next batch.
            earlier = np.flatnonzero(np.any([x != x[-1] for x in rows[:3]], axis=0))
            end = int(earlier[-1]) + 1 if len(earlier) else 0
            yield links([x[:end] for x in rows])
            kept = [x[end:] for x in rows]
        if kept:
            yield links(kept)

    def links(rows: list[np.ndarray]) -> pa.RecordBatch:
        changes = np.any([np.diff(x, prepend=x[:1]) != 0 for x in rows[:3]], axis=0)
        a, b = forest(np.cumsum(changes), rows[3], rows[4], threshold)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def linked_fingerprints(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b) links that connect all fingerprints within the threshold, from a table of distinct fingerprints ``fp``.

    Copies per fingerprint are at most 43 and do not depend on the data. An anchor with more than ``PART_ROWS`` rows is dealt out as pairs of
    parts: still every home row meets every row, in as many tasks as needed and with bounded memory.
    """
    if threshold > 4:
        raise ValueError("the covering holds for thresholds up to 4")
    replicas = settle(fps.select("fp").mapInArrow(_replicas, "anchor bigint, fp bigint, home boolean"), "anchors")
    hot = replicas.groupBy("anchor").count().where(F.col("count") > PART_ROWS)
    hot = settle(hot.select("anchor", F.ceil(F.col("count") / (PART_ROWS // 2)).cast("int").alias("parts")), "hot-anchors")
    none = F.lit(0)
    cold = replicas.join(hot, "anchor", "left_anti").select("anchor", none.alias("i"), none.alias("j"), "fp", "home")
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = replicas.join(hot, "anchor").withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("anchor", (F.least("part", "other") + 1).alias("i"), (F.greatest("part", "other") + 1).alias("j"), "fp", "home")
    n = max(shuffle_width(fps.sparkSession), 1)
    rows = cold.unionByName(dealt).repartition(n, "anchor", "i", "j").sortWithinPartitions("anchor", "i", "j")
    return rows.mapInArrow(_compare(threshold), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id) for every row of ``docs``: the fingerprint as 16 hex digits and the smallest key among all rows that links
    of at most ``threshold`` bits reach, the row itself included.

    Equal fingerprints are one node, so copies cost nothing beyond their own rows. Null and empty texts have fingerprint 0 and link like any
    other. A row without key takes part; a component without any key has a null id. Repeated rows are rows of their own. An empty table
    gives an empty result. Whole texts are read once, and (key, fingerprint) goes to the scratch folder. Other columns are not looked at.
    """
    rows = settle(with_fingerprints(docs, "__fp", text).select(F.col(f"`{key}`").alias("key"), F.col("__fp").alias("fp")), "fingerprints")
    nodes = settle(rows.groupBy("fp").agg(F.min("key").alias("low")), "nodes")
    roots = components(linked_fingerprints(nodes, threshold))
    nodes = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    nodes = settle(nodes, "rooted")
    low = nodes.groupBy("root").agg(F.min("low").alias("component_id"))
    found = nodes.join(low, "root").select(F.col("fp").alias("of"), "component_id")
    return rows.join(found, F.col("fp") == F.col("of")).select(
        F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def shingle_sets(chunk: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit hashes of each text's shingles of ``width`` words, in order, one text after the other, and how many each text has. Words as in
    ``fingerprint``; fewer words are one shingle, no words none."""
    buffer, starts, ends, text = word_spans([b" ".join(t.lower().split()) for t in chunk], _WORDS)
    counts = np.bincount(text, minlength=len(chunk))
    shingles = np.where(counts > 0, np.maximum(counts - width + 1, 1), 0)
    first = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(chunk)), shingles)
    at = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    last = np.minimum(at + width, (first + counts)[owner]) - 1
    hashes = WordHasher().hashes(buffer, starts[at], ends[last])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])])[: len(hashes)]
    return hashes[new], np.bincount(owner[new], minlength=len(chunk))


def set_ids(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set of hashes, the same for equal sets."""
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix64(hashes), out=sums[1:])
    ends = np.cumsum(sizes)
    return mix64(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64)).view(np.int64)


def band_count(least: float) -> int:
    """Bands of which a pair of similarity ``least`` shares one except with chance ``MISS``."""
    return 1 if least >= 1 else math.ceil(math.log(MISS) / math.log1p(-(least**BAND_ROWS)))


def band_keys(hashes: np.ndarray, sizes: np.ndarray, bands: int) -> np.ndarray:
    """Sets with members x bands: a hash of the band's number and of ``BAND_ROWS`` minima of the set, each under a hash function of its own."""
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    factors = mix64(np.arange(1, 2 * bands * BAND_ROWS + 1, dtype=np.uint64)).reshape(-1, 2)
    out = np.empty((len(starts), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(starts), band + 1, np.uint64)
        for flip, factor in factors[band * BAND_ROWS : (band + 1) * BAND_ROWS]:
            key = mix64(key ^ np.minimum.reduceat((hashes ^ flip) * (factor | np.uint64(1)), starts)) if len(starts) else key
        out[:, band] = key
    return out.view(np.int64)


def set_fingerprints(hashes: np.ndarray, sizes: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """SimHash of each set of hashes: bits set in over half of its members, each of which counts once; 0 for an empty set."""
    counts = np.zeros((len(sizes), 64), np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    for at in range(0, len(hashes), step):
        bits = np.unpackbits(hashes[at : at + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.diff(owner[at : at + step], prepend=-1))
        counts[owner[at : at + step][first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > sizes[:, None], axis=1, bitorder="little").view(np.int64).ravel()


def _sketches(bands: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for chunk in text_chunks(batch.column("text")):
                hashes, sizes = shingle_sets(chunk, width)
                keys = band_keys(hashes, sizes, bands)
                bounds = np.append(0, np.cumsum(np.where(sizes > 0, bands, 0))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(keys.ravel()))
                columns = [batch.column("key").slice(at, len(chunk)), pa.array(set_ids(hashes, sizes)), pa.array(sizes.astype(np.int64)), pa.array(set_fingerprints(hashes, sizes)), lists]
                at += len(chunk)
                yield pa.RecordBatch.from_arrays(columns, names=["key", "id", "size", "fp", "bands"])

    return run


def _packed_texts(width: int, wanted):
    """(id, compressed text) of the texts whose id the filter lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for chunk in text_chunks(batch.column("text")):
                ids = set_ids(*shingle_sets(chunk, width))
                asked = np.flatnonzero(filter_holds(wanted.value, ids.view(np.uint64), TEXT_FILTER_BITS))
                yield pa.RecordBatch.from_arrays([pa.array(ids[asked]), pa.array([press.compress(chunk[i]) for i in asked], pa.binary())], names=["id", "packed"])

    return run


def _similar(least: float, width: int):
    """Pairs (a, b, packed text of either) that are similar enough; each text of a batch is read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            for at in range(0, len(a), 512):
                part = batch.slice(at, 512)
                texts: dict[int, int] = {}
                raw = []
                for name, packed in (("a", "of_a"), ("b", "of_b")):
                    for i, value in zip(part.column(name).to_pylist(), part.column(packed), strict=True):
                        if i not in texts:
                            texts[i] = len(raw)
                            raw.append(unpack.decompress(value.as_py()))
                sets = []
                for chunk in text_chunks(pa.array(raw, pa.binary())):
                    hashes, sizes = shingle_sets(chunk, width)
                    sets += np.split(hashes, np.cumsum(sizes)[:-1])
                hit = []
                for x, y in zip(a[at : at + 512].tolist(), b[at : at + 512].tolist(), strict=True):
                    one, two = sets[texts[x]], sets[texts[y]]
                    both = len(np.intersect1d(one, two, assume_unique=True))
                    hit.append(both / (len(one) + len(two) - both) >= least)
                yield pa.RecordBatch.from_arrays([pa.array(a[at : at + 512][hit]), pa.array(b[at : at + 512][hit])], names=["a", "b"])

    return run


def links_among(ids: np.ndarray, part: np.ndarray, root: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, least: float, across: bool) -> list[tuple[int, int]]:
    """Links that join the sets (none empty) of different roots that are similar enough, compared by all their members: a forest of them. ``across``: only
    sets of different parts meet. No set meets its own component, nor do those of the largest component meet each other."""
    members, index = np.unique(hashes, return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    label = np.unique(root, return_inverse=True)[1]
    largest = int(np.argmax(np.bincount(label)))
    held, out = np.zeros(len(members), bool), []
    for x in np.flatnonzero(label != largest):
        apart = label != label[x]
        if across:
            apart &= part != part[x]
        if not apart.any():
            continue
        own = index[starts[x] : starts[x] + sizes[x]]
        held[own] = True
        both = np.add.reduceat(held[index], starts, dtype=np.int64)
        held[own] = False
        hit = np.flatnonzero(apart & (both / (sizes[x] + sizes - both) >= least))
        met, first = np.unique(label[hit], return_index=True)
        out += [(int(ids[x]), int(ids[y])) for y in hit[first]]
        label[np.isin(label, met)] = label[x]
    return out


def _members_of_bands(least: float, width: int):
    """Links (a, b) among the rows (band, i, j, part, id, root, packed) of each band and pair of parts, which come one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        for batch in batches:
            groups = zip(*(batch.column(c).to_pylist() for c in ("band", "i", "j")), strict=True)
            members = zip(*(batch.column(c).to_pylist() for c in ("part", "id", "root", "packed")), strict=True)
            for own, member in zip(groups, members, strict=True):
                if own != group and rows:
                    yield links(rows, group[1] < group[2])
                    rows = []
                group = own
                rows.append(member)
        if rows:
            yield links(rows, group[1] < group[2])

    def links(rows: list[tuple], across: bool) -> pa.RecordBatch:
        unpack = zstandard.ZstdDecompressor()
        part, ids, root, packed = zip(*rows, strict=True)
        hashes, sizes = zip(*(shingle_sets(chunk, width) for chunk in text_chunks(pa.array([unpack.decompress(x) for x in packed], pa.binary()))), strict=True)
        found = links_among(np.array(ids), np.array(part), np.array(root), np.concatenate(hashes), np.concatenate(sizes), least, across)
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _links_in_bands(apart: DataFrame, texts: DataFrame, least: float, width: int, part_shingles: int) -> DataFrame:
    """Links among the members of the bands (band, id, size, root): those of different roots that are similar enough, a forest for each band.

    A band's texts meet in one task, or as pairs of parts if they have more than ``part_shingles`` shingles, so that rows grow with members and memory is
    bounded. Of bands with the same members one is enough.
    """
    same = [F.bit_xor(F.xxhash64("id", F.lit(turn))).alias(f"same{turn}") for turn in range(2)]
    bands = apart.groupBy("band").agg(F.count("*").alias("n"), F.sum("size").alias("total"), *same)
    bands = bands.groupBy("n", "total", "same0", "same1").agg(F.min("band").alias("of"))
    bands = settle(bands.select("of", F.ceil(F.col("total") / part_shingles).cast("int").alias("parts")), "open-bands")
    rows = apart.join(bands, F.col("band") == F.col("of")).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("band", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", F.col("id").alias("own"), "root")
    rows = rows.join(texts, F.col("own") == F.col("id")).select("band", "i", "j", "part", "id", "root", "packed")
    rows = rows.repartition(shuffle_width(apart.sparkSession), "band", "i", "j").sortWithinPartitions("band", "i", "j")
    return settle(rows.mapInArrow(_members_of_bands(least, width), "a bigint, b bigint"), "similar")


def similar_documents(
    docs: DataFrame, least: float = SIMILARITY, width: int = WIDTH, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, part_shingles: int = PART_SHINGLES
) -> DataFrame:
    """(key, set_id, component_id) for every row of ``docs``: the smallest key among all rows that links reach, the row itself included. Two rows link
    if the Jaccard similarity of their distinct shingles of ``width`` words is ``least`` or more.

    Candidates come first from the SimHash fingerprints of the shingles, compared at the anchors of the covering code as in ``near_duplicates``: those within
    ``threshold`` bits. At ``least`` = 0.8 fingerprints lie about ten bits apart, beyond what a covering of 64 bits can find, so that all that are still apart
    meet by bands of minima too: a pair at ``least`` shares no band with chance ``MISS``, a more similar one with less. All candidates are compared by all
    their shingles, so no link is wrong. Equal sets are one node. Members of a band that are still in different components first meet its most central one
    (whose bands hold the most members), and then each other, within a task, see ``_links_in_bands``. A group of n near copies
    about a centre gives about n comparisons. What is compared is the compressed text, of candidates
    only; the others are left out before texts are shuffled. Texts without words are alike; keys as in ``near_duplicates``. An
    empty table gives an empty result; repeated rows are rows of their own; other columns are not looked at.
    """
    body = docs.select(F.col(f"`{key}`").alias("key"), binary(text).alias("text"))
    kind = body.schema["key"].dataType.simpleString()
    rows = settle(body.mapInArrow(_sketches(band_count(least), width), f"key {kind}, id bigint, size bigint, fp bigint, bands array<bigint>"), "sketches")
    held = rows.select(F.explode("bands").alias("band"), "id", "size").distinct()
    held = settle(held, "bands")
    shared = held.groupBy("band").count().where("count > 1").select(F.col("band").alias("of"), "count")
    members = settle(held.join(shared, F.col("band") == F.col("of")).select("band", "id", "size", "count"), "members")
    central = members.groupBy("id").agg(F.sum("count").alias("mates"))
    members = settle(members.join(central.withColumnRenamed("id", "of"), F.col("id") == F.col("of")).select("band", "id", "size", "mates"), "members")
    fingerprinted = settle(rows.where("size > 0").groupBy("fp").agg(F.min(F.struct("id", "size")).alias("low")), "nodes")
    close = settle(_fingerprint_pairs(rows, fingerprinted, threshold), "close")
    candidates = central.select("id").unionByName(close.select("id")).unionByName(close.select(F.col("hub").alias("id"))).distinct()
    wanted = docs.sparkSession.sparkContext.broadcast(bit_filter(candidates.select(F.col("id").alias("key")), TEXT_FILTER_BITS))
    texts = body.select("text").mapInArrow(_packed_texts(width, wanted), "id bigint, packed binary").groupBy("id").agg(F.first("packed").alias("packed"))
    texts = settle(texts.join(candidates.select(F.col("id").alias("of")), F.col("id") == F.col("of"), "left_semi"), "texts")

    def links_of(pairs: DataFrame) -> DataFrame:
        near = F.least("of_size", "size") >= F.lit(least) * F.greatest("of_size", "size")
        pairs = pairs.where(near).select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
        for side in ("b", "a"):
            pairs = pairs.join(texts.select(F.col("id").alias("of"), F.col("packed").alias(f"of_{side}")), F.col(side) == F.col("of")).drop("of")
        return settle(pairs.select("a", "b", "of_a", "of_b").mapInArrow(_similar(least, width), "a bigint, b bigint"), "similar")

    same_band, other_root = F.col("band") == F.col("of"), F.col("root") != F.col("of_root")

    def still_apart(roots: DataFrame) -> DataFrame:
        """Members of the bands that have more than one root."""
        rooted = members.join(roots, F.col("id") == F.col("node"), "left").select("band", "id", "size", "mates", F.coalesce("root", "id").alias("root"))
        rooted = settle(rooted, "rooted-members")
        open_bands = rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select(F.col("band").alias("of"))
        return settle(rooted.join(open_bands, same_band).drop("of"), "apart")

    links = links_of(close)
    apart = still_apart(components(links))
    for turn, hubs in enumerate(STAR_HUBS):
        order = Window.partitionBy("band").orderBy(F.xxhash64("id", F.lit(turn)) if turn else F.desc("mates"), "id")
        best = apart.withColumn("place", F.row_number().over(order)).where(F.col("place") <= hubs)
        best = best.select(F.col("band").alias("of"), F.col("id").alias("hub"), F.col("size").alias("of_size"), F.col("root").alias("of_root"))
        links = links.unionByName(links_of(apart.join(best, same_band & other_root)))
        apart = still_apart(components(links))
    roots = components(links.unionByName(_links_in_bands(apart, texts, least, width, part_shingles)))
    nodes = rows.groupBy("id").agg(F.min("key").alias("low")).join(roots, F.col("id") == F.col("node"), "left")
    nodes = settle(nodes.select("id", "low", F.coalesce("root", "id").alias("root")), "rooted")
    low = nodes.groupBy("root").agg(F.min("low").alias("component_id"))
    found = nodes.join(low, "root").select(F.col("id").alias("of"), "component_id")
    return rows.join(found, F.col("id") == F.col("of")).select(F.col("key").alias(key), F.col("id").alias("set_id"), "component_id")


def _fingerprint_pairs(rows: DataFrame, nodes: DataFrame, threshold: int) -> DataFrame:
    """(hub, of_size, id, size) of sets that fingerprints within the threshold join: of each fingerprint the set with the smallest id stands for it, meets the others
    that have it, and those of other fingerprints along the links."""
    low = lambda name: nodes.select(F.col("fp").alias(name), F.col("low").alias(f"low_{name}"))
    equal = rows.where("size > 0").select("fp", "id", "size").distinct().join(low("a"), F.col("fp") == F.col("a"))
    equal = equal.where(F.col("id") != F.col("low_a.id")).select(F.col("low_a.id").alias("hub"), F.col("low_a.size").alias("of_size"), "id", "size")
    near = linked_fingerprints(nodes, threshold).where("a != b").distinct().join(low("x"), F.col("a") == F.col("x")).join(low("y"), F.col("b") == F.col("y"))
    near = near.select(F.col("low_x.id").alias("hub"), F.col("low_x.size").alias("of_size"), F.col("low_y.id").alias("id"), F.col("low_y.size").alias("size"))
    return equal.unionByName(near)


def drop_near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, key: str = "doc_id", text: str = "text", similarity: float | None = None) -> DataFrame:
    """The rows of ``docs`` without those whose component has a smaller key: one document of each group stays, all columns kept. Links are those of
    ``near_duplicates``, or with ``similarity`` those of ``similar_documents``.

    Rows that share a key are one document. Rows without key stay. The rows to go are the smaller side of the join.
    """
    found = near_duplicates(docs, threshold, key, text) if similarity is None else similar_documents(docs, similarity, key=key, text=text)
    name = fresh_name(docs, "gone")
    gone = settle(found.where(F.col(f"`{key}`") != F.col("component_id")).select(F.col(f"`{key}`").alias(name)).distinct(), "gone")
    return docs.join(gone, F.col(f"`{key}`") == F.col(name), "left_anti")
