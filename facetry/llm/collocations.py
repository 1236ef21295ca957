"""Phrase collocations from a weighted de Bruijn graph: edges are the longest frequent grams, nodes their overlaps, and shorter phrases are counted by node flow."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHasher, binary, bit_filter, filter_holds, mix64, settle, text_chunks, word_spans

#: Words of an edge (the longest phrase), occurrences of a phrase, and phrases reported of each language.
WIDTH, LEAST, TOP = 5, 100, 2000
#: log2 of the bits of the filter that leaves rare phrases out. Its size does not depend on the data.
FILTER_BITS = 27
#: Distinct grams that a task holds before it writes them out; those of one chunk of texts come on top.
HELD_GRAMS = 1 << 18
#: Doublings of the search for the start of an unary path: paths of up to 2 ** PATH_DOUBLINGS edges are one row, longer ones several.
PATH_DOUBLINGS = 4
#: Tasks that the phrases of one language are dealt to where they meet its number of words.
SPREAD = 64


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Which bytes belong to words, and which end pieces."""
    ends = np.zeros(256, bool)
    ends[[*b".,;:!?", *range(10, 14)]] = True
    words = ~ends
    words[[32, 9]] = False
    return words, ends


_WORDS, _ENDS = _tables()


class _Pieces:
    """Words of several texts laid end to end: their bytes, whether the next word follows in the same piece, marks of their texts, and keys of words and pairs."""

    def __init__(self, chunk: list[bytes], langs: list[str], hasher: WordHasher) -> None:
        self.buffer, self.starts, self.ends, self.text = word_spans([t.lower() for t in chunk], _WORDS)
        piece = np.cumsum(_ENDS[self.buffer])[self.starts] if len(self.starts) else np.zeros(0, np.int64)
        self.follows = np.zeros(len(self.starts), bool)
        self.follows[:-1] = (piece[1:] == piece[:-1]) & (self.text[1:] == self.text[:-1])
        salts = np.array([xxhash.xxh64_intdigest(name.encode()) for name in langs], np.uint64)
        self.plain = hasher.hashes(self.buffer, self.starts, self.ends)
        own = salts[self.text] if len(self.plain) else self.plain
        self.words = mix64(self.plain ^ own)
        self.pairs = _longer(self.words[:-1], self.plain[1:])
        marks = np.array([xxhash.xxh64_intdigest(t) & 0xFFFF for t in chunk], np.int64)
        self.marks = marks[self.text] if len(self.text) else np.zeros(0, np.int64)

    def passing(self, filled: np.ndarray, bits: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For 1 to ``width`` words, the words at which grams begin that end with their piece at the latest and that the filter lets pass as well as their own
        beginnings and ends, and the keys of those grams."""
        keys = self.words.copy()
        length = filter_holds(filled, keys, bits).astype(np.int64)
        at = np.flatnonzero(length)
        yield at, keys[at]
        for k in range(2, width + 1):
            at = np.flatnonzero((length[:-1] == k - 1) & (length[1:] >= k - 1) & self.follows[:-1])
            longer = _longer(keys[at], self.plain[at + k - 1])
            held = filter_holds(filled, longer, bits)
            at, longer = at[held], longer[held]
            keys[at], length[at] = longer, k
            yield at, longer

    def lengths(self, filled: np.ndarray, bits: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of the longest passing gram that begins at each word, and its key: all frequent phrases that begin there are beginnings of it. 0: a word that
        does not pass."""
        length, keys = np.zeros(len(self.words), np.int64), self.words.copy()
        for k, (at, longer) in enumerate(self.passing(filled, bits, width), 1):
            keys[at], length[at] = longer, k
        return length, keys

    def named(self, filled: np.ndarray, named: np.ndarray, bits: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where passing grams of any length begin that ``named`` has for their text, their words, and their keys."""
        found = []
        for k, (at, keys) in enumerate(self.passing(filled, bits, width), 1):
            marks = self.marks[at].astype(np.uint64)
            own = filter_holds(named, keys ^ marks ^ (marks << np.uint64(48)), bits)
            found.append((at[own], np.full(int(own.sum()), k), keys[own]))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _longer(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Keys of grams from those of their beginnings and the hashes of their last words."""
    return mix64(keys * np.uint64(0x9E3779B97F4A7C15) + words)


def _languages(batch: pa.RecordBatch, at: int, n: int) -> list[str]:
    return [v if v is not None else "und" for v in batch.column("lang").slice(at, n).to_pylist()]


def _count_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n, mark) of the words and of the pairs of a piece, summed over a chunk of texts."""
    hasher = WordHasher()
    for batch in batches:
        at = 0
        for chunk in text_chunks(batch.column("text")):
            p = _Pieces(chunk, _languages(batch, at, len(chunk)), hasher)
            at += len(chunk)
            pairs = p.follows[:-1]
            yield _counted(np.concatenate([p.words, p.pairs[pairs]]), np.concatenate([p.marks, p.marks[:-1][pairs]]))


def _counted(keys: np.ndarray, marks: np.ndarray) -> pa.RecordBatch:
    """Distinct keys, how often they occur, and the smallest mark of a text that has them."""
    order = np.argsort(keys)
    keys, marks = keys[order], marks[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1]]))
    n = np.diff(first, append=len(keys))
    low = np.minimum.reduceat(marks, first) if len(first) else marks
    return pa.RecordBatch.from_arrays([pa.array(keys[first].view(np.int64)), pa.array(n.astype(np.int64)), pa.array(low)], names=["key", "n", "mark"])


def _count_longer(shared, bits: int, k: int):
    """(key, n, mark) of the grams of ``k`` words whose two grams of one word less the filter lets pass, summed over a chunk of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            at = 0
            for chunk in text_chunks(batch.column("text")):
                p = _Pieces(chunk, _languages(batch, at, len(chunk)), hasher)
                at += len(chunk)
                length, keys = p.lengths(shared.value, bits, k - 1)
                both = np.flatnonzero((length[:-1] == k - 1) & (length[1:] == k - 1))
                yield _counted(_longer(keys[both], p.plain[both + k - 1]), p.marks[both])

    return run


def _frequent(docs: DataFrame, run, least: int) -> DataFrame:
    counted = docs.mapInArrow(run, "key bigint, n bigint, mark bigint").groupBy("key").agg(F.sum("n").alias("n"), F.min("mark").alias("mark"))
    return settle(counted.where(F.col("n") >= least), "frequent")


def frequent_keys(docs: DataFrame, least: int = LEAST, bits: int = FILTER_BITS, width: int = WIDTH) -> tuple[np.ndarray, DataFrame]:
    """A Bloom filter of the words and phrases of up to ``width`` words that occur at least ``least`` times, as 64-bit words of ``2 ** bits`` bits; and
    (key, n, mark) of these phrases: how often each occurs, and the smallest mark of a text that has it.

    All occurrences are counted, of three words or more those whose beginning and end passed. The filter has one size at any number of keys; where it fills up, it
    lets more that is rare pass, which costs counting and never a phrase.
    """
    counted = _frequent(docs, _count_keys, least)
    filled = bit_filter(counted.select("key"), bits)
    for k in range(3, width + 1):
        shared = docs.sparkSession.sparkContext.broadcast(filled)
        longer = _frequent(docs, _count_longer(shared, bits, k), least)
        filled, counted = filled | bit_filter(longer.select("key"), bits), counted.unionByName(longer)
    return filled, counted


def _names(counted: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of keys with their marks: which texts write a phrase out. One text does, or the few that share its smallest mark, wherever they lie."""
    return bit_filter(counted.select(F.col("key").bitwiseXOR(F.col("mark")).bitwiseXOR(F.shiftleft("mark", 48)).alias("key")), bits)


class _Held:
    """Grams of a task and how often they occurred, told apart by their keys; a gram's words are looked up where it is new."""

    def __init__(self) -> None:
        self.keys, self.n, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.grams: list[tuple[str, str, int]] = []

    def add(self, keys: np.ndarray, n: np.ndarray, gram_of) -> None:
        """Distinct keys in order with their counts; ``gram_of`` gives (lang, gram, k) of some of them by position."""
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = np.flatnonzero(at < len(self.keys))
        known[inside] = self.keys[at[inside]] == keys[inside]
        self.n[at[known]] += n[known]
        new = np.flatnonzero(~known)
        places = len(self.grams) + np.arange(len(new))
        self.grams += gram_of(new)
        self.keys, self.n, self.place = (np.insert(x, at[new], y) for x, y in ((self.keys, keys[new]), (self.n, n[new]), (self.place, places)))

    def rows(self, totals: Counter[str]) -> pa.RecordBatch:
        langs, grams, ks = zip(*self.grams, strict=True) if self.grams else ((), (), ())
        n, keys = np.empty_like(self.n), np.empty_like(self.keys)
        n[self.place], keys[self.place] = self.n, self.keys
        some = [(lang, c) for lang, c in totals.items() if c]
        columns = [[*langs, *(lang for lang, _ in some)], [*grams, *(None for _ in some)], [*ks, *(0 for _ in some)], [*n.tolist(), *(c for _, c in some)]]
        columns.append([*keys.view(np.int64).tolist(), *(None for _ in some)])
        types = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["lang", "gram", "k", "n", "key"])


def _edges(filled, bits: int, width: int, most: int = HELD_GRAMS, named=None):
    """(lang, gram, k, n, key): for every word the gram of ``width`` words that begins there, or as much of it as lies in its piece and is frequent; rare words
    begin none. With ``named``: instead all of its beginnings, each from the texts that write it out alone, so that a gram's rows do not grow with tasks.
    ``k`` = 0: all words of a language. Summed over a task, or over as many of its chunks of texts as have ``most`` grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        held, totals = _Held(), Counter()
        for batch in batches:
            at = 0
            for chunk in text_chunks(batch.column("text")):
                langs = _languages(batch, at, len(chunk))
                at += len(chunk)
                p = _Pieces(chunk, langs, hasher)
                if named is None:
                    length, keys = p.lengths(filled.value, bits, width)
                    begins = np.flatnonzero(length)
                    length, keys = length[begins], keys[begins]
                else:
                    begins, length, keys = p.named(filled.value, named.value, bits, width)
                keys, first, some = np.unique(keys, return_index=True, return_counts=True)

                def gram_of(new: np.ndarray, p=p, langs=langs, at=begins[first], k=length[first]) -> list[tuple[str, str, int]]:
                    raw = p.buffer.tobytes()
                    spans = zip(p.starts[at[new]].tolist(), p.ends[at[new] + k[new] - 1].tolist(), k[new].tolist(), p.text[at[new]].tolist(), strict=True)
                    return [(langs[t], b" ".join(raw[s:e].split()).decode("utf-8", "replace"), k) for s, e, k, t in spans]  # within a piece only spaces and tabs part words

                held.add(keys, some.astype(np.int64), gram_of)
                for t, some in enumerate(np.bincount(p.text, minlength=len(chunk)).tolist()):
                    totals[langs[t]] += some
                if len(held.keys) >= most:
                    yield held.rows(totals)
                    held, totals = _Held(), Counter()
        yield held.rows(totals)

    return run


def _first(gram: Column, k: Column | int) -> Column:
    """The first ``k`` words of a gram, or the last -k."""
    return F.call_function("substring_index", gram, F.lit(" "), F.lit(k) if isinstance(k, int) else k.cast("int"))


def unary_paths(edges: DataFrame, width: int = WIDTH, doublings: int = PATH_DOUBLINGS) -> DataFrame:
    """(lang, words, n): the edges (lang, gram, n) of a graph whose nodes are ``width`` - 1 words, chains of them as one row.

    Two edges are one path where the node between them has no other edge and both weigh the same, so that nothing begins or ends there. Every edge looks for
    the start of its path by doubling; those further away than 2 ** ``doublings`` edges, and cycles, stay single edges. All windows of ``width`` words of the
    paths together are the edges again.
    """
    head, tail = _first(F.col("gram"), width - 1), _first(F.col("gram"), 1 - width)
    edges = settle(edges.select("lang", "gram", "n", head.alias("head"), tail.alias("tail")), "edges")
    out = edges.groupBy(F.col("lang").alias("l1"), F.col("head").alias("node")).agg(F.count("*").alias("outs"), F.min(F.struct("gram", "n")).alias("after"))
    into = edges.groupBy(F.col("lang").alias("l2"), F.col("tail").alias("of")).agg(F.count("*").alias("ins"), F.min(F.struct("gram", "n")).alias("before"))
    unary = out.where("outs = 1").join(into.where("ins = 1"), (F.col("l1") == F.col("l2")) & (F.col("node") == F.col("of")))
    unary = unary.where("after.n = before.n AND after.gram != before.gram").select("l1", F.col("after.gram").alias("later"), F.col("before.gram").alias("earlier"))
    # hop: an edge that has an edge before it, how far it has looked back, and whether what it found has none before it
    hops = settle(unary.select("l1", "later", F.col("earlier").alias("start"), F.lit(1).alias("steps")), "hops")
    for _ in range(doublings):
        onward = hops.select(F.col("l1").alias("l2"), F.col("later").alias("of"), F.col("start").alias("further"), F.col("steps").alias("more"))
        step = hops.join(onward, (F.col("l1") == F.col("l2")) & (F.col("start") == F.col("of")), "left")
        hops = settle(step.select("l1", "later", F.coalesce("further", "start").alias("start"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")), "hops")
    begun = hops.select(F.col("l1").alias("l2"), F.col("later").alias("of"))
    hops = hops.join(begun, (F.col("l1") == F.col("l2")) & (F.col("start") == F.col("of")), "left_anti")
    placed = edges.join(hops, (F.col("lang") == F.col("l1")) & (F.col("gram") == F.col("later")), "left")
    placed = placed.select("lang", "n", F.coalesce("start", "gram").alias("start"), F.coalesce("steps", F.lit(0)).alias("steps"), _first(F.col("gram"), -1).alias("last"))
    chains = placed.groupBy("lang", "start").agg(F.min("n").alias("n"), F.array_sort(F.collect_list(F.struct("steps", "last"))).alias("chain"))  # at most 2 ** doublings + 1
    more = F.transform(F.slice("chain", 2, F.size("chain")), lambda c: c["last"])
    return chains.select("lang", F.concat(F.split("start", " ", -1), more).alias("words"), "n")


def _written(body: DataFrame, least: int, bits: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Counts of the frequent phrases by key, and rows (lang, gram, k, n, key) of the texts that write them out and of the words of languages."""
    filled, counted = frequent_keys(body, least, bits, width)
    share = body.sparkSession.sparkContext.broadcast
    edges = _edges(share(filled), bits, width, named=share(_names(counted, bits)))
    return counted, settle(body.mapInArrow(edges, "lang string, gram string, k int, n bigint, key bigint"), "written")


def phrase_graph(docs: DataFrame, lang: str = "lang", text: str = "text", width: int = WIDTH, least: int = LEAST, bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph of all phrases of up to ``width`` words as three tables: ``paths`` (lang, words, n), the edges with their unary paths compacted;
    ``ends`` (lang, gram, k, n), the shorter grams with which pieces or frequent phrases end; ``totals`` (lang, n), the words of each language.

    Every word begins one gram at most: ``width`` words, or fewer where its piece ends or where more of them, in a row, occur fewer than ``least`` times. No
    phrase that occurs so often goes on there, so that the counts of all frequent phrases are whole. A gram's words are written out by one text, or few; at how many
    words it ends is how often it occurs less how often the frequent grams of one word more do that begin with it.
    """
    body = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), binary(text).alias("text"))
    counted, written = _written(body, least, bits, width)
    if not counted.join(written.select("key"), "key", "left_anti").isEmpty():  # texts that each pass reads otherwise, as an unseeded function makes them
        counted, written = _written(settle(body, "texts"), least, bits, width)
    grams = written.where("k > 0").select("lang", "k", "gram", "key").distinct().join(counted.select("key", "n"), "key")
    grams = settle(grams.groupBy("lang", "k", "gram").agg(F.sum("n").alias("n")), "grams")
    onward = grams.where("k > 1").groupBy(F.col("lang").alias("of"), _first(F.col("gram"), F.col("k") - 1).alias("begun")).agg(F.sum("n").alias("onward"))
    grams = grams.join(onward, (F.col("lang") == F.col("of")) & (F.col("gram") == F.col("begun")), "left")
    grams = settle(grams.select("lang", "k", "gram", (F.col("n") - F.coalesce("onward", F.lit(0))).alias("n")).where("n > 0"), "grams")
    paths = settle(unary_paths(grams.where(F.col("k") == width).select("lang", "gram", "n"), width), "paths")
    return paths, grams.where(F.col("k") < width), written.where("k = 0").groupBy("lang").agg(F.sum("n").alias("n"))


def phrase_counts(paths: DataFrame, ends: DataFrame, width: int = WIDTH) -> DataFrame:
    """(lang, k, phrase, n): how often each phrase of 1 to ``width`` words occurs: what flows through its node, that is all edges that begin with it, and
    the piece ends that do."""
    at = F.explode(F.sequence(F.lit(1), F.size("words") - width + 1))
    edges = paths.select("lang", "n", "words", at.alias("at")).select("lang", "n", F.array_join(F.slice("words", F.col("at"), width), " ").alias("gram"), F.lit(width).alias("k"))
    grams = edges.unionByName(ends.select("lang", "n", "gram", "k"))
    each = grams.select("lang", "n", "gram", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("k"))
    return each.groupBy("lang", "k", _first(F.col("gram"), F.col("k")).alias("phrase")).agg(F.sum("n").alias("n"))


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", width: int = WIDTH, least: int = LEAST, top: int = TOP, bits: int = FILTER_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of 2 to ``width`` words of each language.

    A phrase with ``a`` >= ``least`` occurrences is cut in two where floor(1000 a n / (l r)) is lowest (ties: the earliest cut); l and r are the counts of
    its parts, n all words of the language. Phrases inside a longer one that occurs as often are left out. By score, then a, both falling, then phrase in
    byte order. Products are decimals of 38 digits. Pieces end at . , ; : ! ? and line breaks, words at spaces and tabs. Null languages are ``und``, null and
    empty texts have no words, repeated rows count repeatedly, an empty table gives an empty result; other columns are not looked at.
    """
    paths, ends, totals = phrase_graph(docs, lang, text, width, least, bits)
    counts = phrase_counts(paths, ends, width).where(F.col("n") >= least)
    counts = settle(counts.select("lang", "k", "phrase", F.col("n").alias("a")), "counts")
    candidates = counts.where("k > 1")
    cuts = candidates.select("lang", "k", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    right = _first(F.col("phrase"), F.col("cut") - F.col("k"))  # a negative count takes the last words
    cuts = cuts.select("lang", "k", "phrase", "a", "cut", _first(F.col("phrase"), F.col("cut")).alias("left"), right.alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        parts = counts.select(F.col("lang").alias("of"), F.col("phrase").alias("part"), F.col("a").alias(name))
        cuts = cuts.join(parts, (F.col("lang") == F.col("of")) & (F.col(side) == F.col("part"))).drop("of", "part")
    spread = F.sequence(F.lit(0), F.lit(SPREAD - 1))  # a language's phrases meet its total in as many tasks
    totals = totals.select(F.col("lang").alias("of"), "n", F.explode(spread).alias("in"))
    cuts = cuts.join(totals, (F.col("lang") == F.col("of")) & (F.pmod(F.xxhash64("phrase"), F.lit(SPREAD)) == F.col("in"))).drop("of", "in")
    exact = lambda name: F.col(name).cast("decimal(16,0)")
    cuts = cuts.withColumn("above", exact("a") * F.lit(1000).cast("decimal(4,0)") * exact("n")).withColumn("below", exact("l") * exact("r"))
    cuts = cuts.withColumn("score", F.expr("above div below"))
    scored = cuts.groupBy("lang", "phrase", "k", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("low"))
    inner = candidates.where("k > 2").select("lang", "phrase", "a", "k", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("m"))
    inner = inner.select("lang", "a", "phrase", "m", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("m") + 1)).alias("at"))
    inner = inner.select(F.col("lang").alias("of"), "a", F.array_join(F.slice(F.split("phrase", " ", -1), F.col("at"), F.col("m")), " ").alias("part"))
    inner = inner.groupBy("of", "part").agg(F.max("a").alias("longer"))
    scored = scored.join(inner, (F.col("lang") == F.col("of")) & (F.col("phrase") == F.col("part")), "left").where("longer is null OR longer < a")
    order = Window.partitionBy("lang").orderBy(F.desc("low.score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "low.l", "low.r", "n", "low.score")
