"""Scores of texts under a hierarchical Pitman-Yor language model whose seating is sampled by Gibbs steps."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import RDD, Broadcast, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, binary, mix64, settle, shuffle_width, text_chunks, whitespace_words, word_spans

#: Most frequent contexts, whose totals all tasks hold. Every other previous word has a restaurant of its own too, whose totals the task of its bucket has.
CONTEXTS = 16_384
#: Most frequent words, whose pairs with other contexts are dealt by context, so that no task has all pairs of one of them.
SPLIT = 4_096
#: Words with this share of the training tokens or more are scored where they are read, without a shuffle, after one of the frequent contexts. There are at most
#: 1 / HOT of them, so their table of probabilities (4 bytes a context) has 33 MB at most.
HOT = 2e-3
#: Sweeps before the first sample, and samples. At the first sample totals of tables have settled.
BURN_IN, SAMPLES = 5, 5
#: Dishes of at most so many customers draw their tables exactly; the others take so many steps of a chain. Numbers that a task looks at together.
TABULATED, STEPS, CELLS = 256, 16, 1 << 20
CHUNK = 4 << 20
#: Numbers of frequent words and contexts lie below this, hashes of all others do not.
LEAST = 1 << 16
END, START = 0x454E445F544F4B45, 0x53544152545F544F
_WORDS = whitespace_words()
PAIRS = "bucket int, data binary"
SEATED = "bucket int, data binary, seats binary, shares binary"


@dataclass
class Settings:
    """Discount and concentration of context restaurants and of the word restaurant above them; all else that tasks need to agree on."""

    discount: float = 0.8
    concentration: float = 1.0
    word_discount: float = 0.7
    word_concentration: float = 1.0
    seed: int = 11
    buckets: int = 8
    shared: int = CONTEXTS
    split: int = SPLIT


@dataclass
class Totals:
    """What restaurants share at the end of a sweep: tables per frequent context, guests and tables of the word restaurant, and of its frequent words."""

    tables: np.ndarray
    guests: float
    top: float
    hot_guests: np.ndarray = field(default_factory=lambda: np.zeros(0))
    hot_top: np.ndarray = field(default_factory=lambda: np.zeros(0))


@dataclass
class Corpus:
    tokens: int
    words: int
    customers: np.ndarray
    sweeps: list[Totals] = field(default_factory=list)
    hot_counts: np.ndarray = field(default_factory=lambda: np.zeros(0))


class Frequent:
    """Hashes of the frequent contexts, and of the words that are dealt by context, in order. A word's or context's id is its place there, or else its hash."""

    def __init__(self, contexts: np.ndarray, words: np.ndarray) -> None:
        self.contexts, self.words = contexts, words
        self.start = int(np.searchsorted(contexts, np.uint64(START)))
        self.number = np.full(len(contexts) + 1, -1)
        self.number[np.searchsorted(contexts, words)] = np.arange(len(words))
        self.first = np.searchsorted(contexts >> np.uint64(48), np.arange(1 << 16, dtype=np.uint64))
        self.most = int(np.bincount((contexts >> np.uint64(48)).astype(np.int64), minlength=1).max())

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash among the frequent contexts, -1 if it is none."""
        out, at = np.full(len(hashes), -1), self.first[(hashes >> np.uint64(48)).astype(np.int64)]
        for i in range(self.most):
            place = np.minimum(at + i, len(self.contexts) - 1)
            out = np.where(self.contexts[place] == hashes, place, out)
        return out

    def ids(self, hashes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, and of the same words as contexts."""
        number = self.number[places]
        return np.where(number >= 0, number.astype(np.uint64), hashes), np.where(places >= 0, places.astype(np.uint64), hashes)

    def homes(self, word: np.ndarray, context: np.ndarray, buckets: int) -> np.ndarray:
        """Bucket of each pair: that of its word, or of its context if only that is no frequent one."""
        key = word.copy()
        hot = word < LEAST
        key[hot] = np.where(context[hot] >= LEAST, context[hot], self.words[word[hot].astype(np.int64)])
        return _bucket(key, buckets)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(hashes) % np.uint64(buckets)).astype(np.int64)


class Tokens:
    """Words, contexts and texts of all tokens of a chunk: the words of each text in order, then its end."""

    def __init__(self, frequent: Frequent | None = None) -> None:
        self.hasher, self.frequent = WordHasher(), frequent

    def hashed(self, chunk: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes and texts of all tokens, and which of them come first in their texts."""
        lowered = [t.lower() for t in chunk]
        buffer, starts, ends, text = word_spans(lowered, _WORDS)
        words = self.hasher.hashes(buffer, starts, ends)
        words[words < LEAST] += np.uint64(LEAST)
        counts = np.bincount(text, minlength=len(chunk))
        stops = np.cumsum(counts + 1) - 1
        token = np.empty(len(words) + len(chunk), np.uint64)
        is_word = np.ones(len(token), bool)
        is_word[stops] = False
        token[is_word], token[stops] = words, END
        return token, np.repeat(np.arange(len(chunk)), counts + 1), np.append(0, stops[:-1] + 1)

    def read(self, chunk: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words and contexts of all tokens (hashes, where there are no frequent ones to number), and their texts."""
        token, text, first = self.hashed(chunk)
        if self.frequent is None:
            return token, _before(token, first, START), text
        word, context = self.frequent.ids(token, self.frequent.places(token))
        return word, _before(context, first, self.frequent.start), text


def _before(values: np.ndarray, first: np.ndarray, start: int) -> np.ndarray:
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[first] = start
    return out


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned integers in the fewest bytes each, and of floats as they are, compressed."""
    parts = []
    for a in arrays:
        if a.dtype.kind != "f":
            a = a.astype(np.min_scalar_type(int(a.max(initial=0))))
        parts += [struct.pack("<2sq", a.dtype.str[1:].encode(), len(a)), a.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(raw: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(raw), 0, []
    while at < len(data):
        kind, n = struct.unpack_from("<2sq", data, at)
        out.append(np.frombuffer(data, np.dtype("<" + kind.decode()), n, at + 10))
        at += 10 + out[-1].nbytes
    return out


def _pack_pairs(words: np.ndarray, sizes: np.ndarray, contexts: np.ndarray, *columns: np.ndarray) -> bytes:
    """Pairs word by word, words in order of their ids: numbers of frequent ones take few bytes, and so do contexts that are words here."""
    few, rare = np.searchsorted(words, np.uint64(LEAST)), np.flatnonzero(contexts >= LEAST)
    at, found = _find(words[few:], contexts[rare])
    marks = contexts.copy()
    marks[rare] = np.where(found, np.uint64(LEAST - 2), np.uint64(LEAST - 1))
    return _pack(words[:few], words[few:], sizes, marks, contexts[rare[~found]], at[found], *columns)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``wanted`` are among ordered keys, and whether they are."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _unpack_pairs(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    few, many, sizes, marks, rare, at, *columns = _unpack(raw)
    contexts, many = marks.astype(np.uint64), many.astype(np.uint64)
    contexts[marks == LEAST - 1] = rare
    contexts[marks == LEAST - 2] = many[at]
    return np.concatenate([few.astype(np.uint64), many]), sizes.astype(np.int64), contexts, [c.astype(np.int64) for c in columns]


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and size of each run of equal values."""
    first = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(sorted_values)))


def _sum_pairs(word: np.ndarray, context: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every distinct pair and its summed count, word by word. Pairs are told apart by a hash."""
    code = mix64(mix64(context) + word)
    order = np.argsort(code)
    first, _ = _runs(code[order])
    total = np.add.reduceat(count[order], first) if len(first) else count
    order = order[first]
    word, context = word[order], context[order]
    order = np.argsort(word, kind="stable")
    return word[order], context[order], total[order]


def _most_frequent(texts: DataFrame, settings: Settings) -> Frequent:
    """The most frequent words, counted over all texts. Tasks leave words out that are far from them, which matters to where pairs are held, not to the model."""
    shared = settings.shared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, held = Tokens(), [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]

        def most(n: int) -> tuple[np.ndarray, np.ndarray]:
            words, index = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
            counts = np.bincount(index, np.concatenate([c for _, c in held]))
            best = np.lexsort((words, -counts))[:n]
            return words[best], counts[best]

        for batch in batches:
            for chunk in text_chunks(batch.column(0), CHUNK):
                held.append(np.unique(tokens.hashed(chunk)[0], return_counts=True))
                if sum(len(w) for w, _ in held) > 64 * CONTEXTS + 2 * shared:
                    held = [most(16 * CONTEXTS + shared)]
        words, counts = most(CONTEXTS + shared)
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts.astype(np.int64))], names=["word", "n"])

    found = texts.mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    words = np.array([r["word"] for r in found.orderBy(F.desc("n"), "word").limit(shared).collect()], np.int64).view(np.uint64)
    split = words[:0] if len(words) < shared else words[: min(settings.split, shared - 1)]
    return Frequent(np.unique(np.append(words[: shared - 1], np.uint64(START))), np.sort(split))


def _count(frequent: Broadcast, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, known = Tokens(), frequent.value
        for batch in batches:
            for chunk in text_chunks(batch.column(0), CHUNK):
                token, _, first = tokens.hashed(chunk)
                hashes, index = np.unique(token, return_inverse=True)
                word, context = known.ids(hashes, known.places(hashes))
                order = np.argsort(word)
                rank = np.empty(len(word), np.int64)
                rank[order] = np.arange(len(word))
                code = np.sort(rank[index] * (len(word) + 1) + _before(index, first, len(word)))
                at, counts = _runs(code)
                pairs = code[at]
                word, context = word[order][pairs // (len(word) + 1)], np.append(context, np.uint64(known.start))[pairs % (len(word) + 1)]
                bucket, data = _dealt(word, context, known.homes(word, context, buckets), counts)
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(data, pa.binary())], names=["bucket", "data"])

    return run


def _dealt(word: np.ndarray, context: np.ndarray, bucket: np.ndarray, column: np.ndarray) -> tuple[list[int], list[bytes]]:
    """For each bucket its pairs, which come in order of words, with a column of theirs."""
    order = np.argsort(bucket.astype(np.min_scalar_type(int(bucket.max(initial=0)))), kind="stable")
    out_bucket, out = [], []
    for f, k in zip(*_runs(bucket[order]), strict=True):
        part = order[f : f + k]
        first, sizes = _runs(word[part])
        out_bucket.append(int(bucket[part[0]]))
        out.append(_pack_pairs(word[part][first], sizes, context[part], column[part]))
    return out_bucket, out


def _merge(rows: Iterator[tuple[int, bytes]]) -> Iterator[tuple]:
    """Adds up the rows of a bucket and holds no more than its distinct pairs and some rows to add."""
    bucket, held, size = None, [], 0
    for bucket, raw in rows:  # noqa: B007  one bucket a partition
        words, sizes, contexts, (counts,) = _unpack_pairs(raw)
        held.append((np.repeat(words, sizes), contexts, counts))
        size += len(contexts)
        if len(held) > 1 and size > max(2_000_000, 2 * len(held[0][0])):
            held = [_sum_pairs(*(np.concatenate(c) for c in zip(*held, strict=True)))]
            size = len(held[0][0])
    if held:
        word, context, count = _sum_pairs(*(np.concatenate(c) for c in zip(*held, strict=True)))
        first, sizes = _runs(word)
        yield bucket, (DATA, bucket, _pack_pairs(word[first], sizes, context, count))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) - shift


@lru_cache(maxsize=4)
def _log_stirling(discount: float) -> np.ndarray:
    """log S(c, t), the generalised Stirling numbers of a discount, for c and t up to ``TABULATED``; -inf where there are none."""
    out = np.full((TABULATED + 1, TABULATED + 1), -np.inf)
    out[1, 1] = 0
    t = np.arange(1, TABULATED + 1)
    for c in range(1, TABULATED):
        with np.errstate(divide="ignore"):
            out[c + 1, 1:] = np.logaddexp(out[c, :-1], np.log(np.maximum(c - t * discount, 0)) + out[c, 1:])
    return out


def _root(rises: Callable[[np.ndarray], np.ndarray], n: int) -> np.ndarray:
    """n positive numbers below which ``rises`` holds, to about three digits, which is enough for a contour or a proposal."""
    low, high = np.full(n, -25.0), np.full(n, 3.0)
    for _ in range(16):
        middle = (low + high) / 2
        more = rises(np.exp(middle))
        low, high = np.where(more, middle, low), np.where(more, high, middle)
    return np.exp((low + high) / 2)


def _log_share(t: np.ndarray, customers: np.ndarray, weight: np.ndarray, discount: float, saddle: np.ndarray | None = None) -> np.ndarray:
    """log of S(c, t) weight^t up to a constant of the dish, for many customers.

    Tables are a Poisson number of sizes with generating function 1 - (1 - x)^discount, given their sum c. The coefficient of x^c is an integral over
    s = -log x through the saddle point (of this number of tables, or a given one nearby): along a parabola, where it converges fast, or round the circle
    where all but a few customers have a table.
    """

    def log_sizes(s: np.ndarray) -> np.ndarray:
        return np.log(-np.expm1(discount * np.log1p(-np.exp(-s))))

    def steep(s: np.ndarray) -> np.ndarray:
        x = np.exp(-s)
        return t * discount * x * (1 - x) ** (discount - 1) / -np.expm1(discount * np.log1p(-x)) > customers

    peak = np.maximum(_root(steep, len(t)) if saddle is None else saddle, 4 / customers)
    place = np.arange(0.5, 24)
    theta = 0.19 * place / np.sqrt(np.minimum(peak, 0.4) * customers)[:, None]
    near = (customers - t <= 32)[:, None]
    s = peak[:, None] + np.where(near, 1j * place * np.pi / 24, peak[:, None] * (2j * theta - theta**2))
    value = customers[:, None] * s + t[:, None] * log_sizes(s)
    top = value.real.max(axis=1)
    slope = np.where(near, np.pi / 96, (1 + 1j * theta) * peak[:, None] * theta[:, :1])
    whole = (np.exp(value - top[:, None]) * slope).real.sum(axis=1)
    return top + np.log(np.maximum(whole, 1e-300)) + t * np.log(weight / discount) - _log_gamma(t + 1)


def _walk(start: np.ndarray | None, customers: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Metropolis-Hastings steps for dishes of many customers: in turn a Poisson draw of the tables beyond one (or, if most customers have their own, of
    customers without) about the likely number, and a step nearby."""
    s = _root(lambda s: weight * np.exp(-s) * (-np.expm1(-s)) ** (discount - 1) > customers, len(customers))
    likely = np.minimum(weight / discount * -np.expm1(discount * np.log(-np.expm1(-s))), customers)
    few = likely <= customers / 2
    mean = np.maximum(np.where(few, likely, customers - likely), 0.1)
    reach = np.sqrt(mean + 1)
    t = np.clip(np.rint(likely) if start is None else start.astype(float), 1, customers)
    saddle = s if start is None else None
    held = _log_share(t, customers, weight, discount, saddle)
    for i in range(STEPS):
        if i % 2:
            other, gap = t + np.rint(rng.standard_normal(len(t)) * reach), np.zeros(len(t))
        else:
            drawn = rng.poisson(mean)
            other, now = np.where(few, 1.0 + drawn, customers - drawn), np.where(few, t - 1, customers - t)
            gap = (now - drawn) * np.log(mean) - _log_gamma(now + 1) + _log_gamma(drawn + 1.0)
        fits = (other >= 1) & (other <= customers)
        other = np.where(fits, other, t)
        value = _log_share(other, customers, weight, discount, saddle)
        taken = fits & (np.log(rng.random(len(t))) < value - held + gap)
        t, held = np.where(taken, other, t), np.where(taken, value, held)
    return t


def gibbs_tables(tables: np.ndarray | None, customers: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """A Gibbs step for the number of tables of each dish given everything else: its conditional is proportional to S(c, t) weight^t, with S the
    generalised Stirling numbers. Up to ``TABULATED`` customers it is an exact draw from that distribution; dishes of more take ``STEPS``
    Metropolis-Hastings steps, which leave it invariant, from ``tables``, or without those from about the likeliest number."""
    out = np.ones(len(customers))
    weight = np.maximum(weight, 1e-12)
    width = 2  # of dishes with up to so many customers and more than half of that, drawn side by side
    while width <= TABULATED:
        some = np.flatnonzero((customers <= width) & (customers > width // 2))
        t = np.arange(1, width + 1)
        for at in np.array_split(some, -(-len(some) * width // CELLS)) if len(some) else []:
            share = np.log(weight[at])[:, None] * t + _log_stirling(discount)[customers[at].astype(np.int64), 1 : width + 1]
            share = np.cumsum(np.exp(share - share.max(axis=1, keepdims=True)), axis=1)
            out[at] = np.minimum(1 + (share <= (rng.random(len(at)) * share[:, -1])[:, None]).sum(axis=1), customers[at])
        width *= 2
    many = np.flatnonzero(customers > TABULATED)
    for at in np.array_split(many, -(-len(many) // (CELLS // 64))) if len(many) else []:
        c = customers[at].astype(float)
        out[at] = _walk(None if tables is None else tables[at], c, weight[at], discount, rng)
    return out


def _parent(s: Settings, corpus: Corpus, sweep: int, guests: np.ndarray, top: np.ndarray) -> np.ndarray:
    """What the word restaurant gives words of so many guests and tables."""
    t = corpus.sweeps[sweep]
    backoff = (s.word_concentration + s.word_discount * t.top) / (s.word_concentration + t.guests)
    return (guests - s.word_discount * top) / (s.word_concentration + t.guests) + backoff / (corpus.words + 1)


class Seating:
    """The state of one bucket of words: it depends on the counts, the seed and the totals of earlier sweeps alone, so that any task can make it again.
    ``seats`` is what the next sweep and the model need of it. Its pairs are those of its words, and some of words dealt by context: ``owner`` numbers the
    bucket's words first, then all that are dealt by context. ``contexts`` are frequent contexts, or ``shared`` for any other."""

    def __init__(self, bucket: int, data: bytes, settings: Settings, corpus: Corpus) -> None:
        words, sizes, self.context_ids, (self.counts,) = _unpack_pairs(data)
        hot = int(np.searchsorted(words, np.uint64(LEAST)))
        self.words, self.contexts = words[hot:], np.minimum(self.context_ids, np.uint64(settings.shared)).astype(np.int64)
        n = len(self.words)
        self.owner = np.repeat(np.concatenate([n + words[:hot].astype(np.int64), np.arange(n)]), sizes)
        self.owners = n + len(corpus.hot_counts)
        self.word_counts = np.bincount(self.owner, self.counts, self.owners)[:n]
        self.bucket, self.settings, self.corpus = bucket, settings, corpus
        self.tables = np.ones(len(self.counts))
        self.guests = sizes[hot:].astype(float)
        self.top = np.ones(n)
        self.sampled = np.zeros(len(self.counts))
        self.samples: list[np.ndarray] = []
        # Tables of a dish with one customer are one, so only other dishes of contexts that are not frequent depend on totals of other buckets, or change them.
        self.several = np.flatnonzero(self.counts > 1)
        self.live = self.several[self.contexts[self.several] == settings.shared]

    def asked(self) -> tuple[np.ndarray, np.ndarray, list[tuple[int, slice]]]:
        """Contexts of live dishes bucket by bucket, which of them each live dish has, and where those of each bucket are."""
        keys, at = np.unique(self.context_ids[self.live], return_inverse=True)
        bucket = _bucket(keys, self.settings.buckets)
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.arange(len(keys))
        return keys[order], rank[at], [(int(bucket[order[f]]), slice(f, f + k)) for f, k in zip(*_runs(bucket[order]), strict=True)]

    def seats(self) -> bytes:
        """Guests and tables per word, summed tables of the samples per pair, and guests and tables per word of each sample."""
        return _pack(*(x.astype(np.int64) for x in (self.guests, self.top, self.sampled, *self.samples)))

    def sit(self, seats: bytes | None) -> Seating:
        if seats is not None:
            self.guests, self.top, self.sampled, *self.samples = (x.astype(float) for x in _unpack(seats))
        return self

    def take(self) -> None:
        self.sampled = self.sampled + self.tables
        self.samples += [self.guests, self.top]

    def sums(self, customers: bool) -> list[np.ndarray]:
        """Tables (and customers) per frequent context, guests (and customers) per word dealt by context; guests and tables of the other words, tokens and words."""
        shared, n = self.settings.shared, len(self.words)
        per_context = [np.bincount(self.contexts, x, shared + 1)[:shared] for x in (self.tables, self.counts)[: 1 + customers]]
        per_word = [np.bincount(self.owner, x, self.owners)[n:] for x in (self.tables, self.counts)[: 1 + customers]]
        return [*per_context, *per_word, np.array([self.guests.sum(), self.top.sum(), self.counts.sum(), n], float)]

    def averaged(self, sweeps: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """What ``model`` gives, from the samples taken in these sweeps, of frequent contexts."""
        s, parent = self.settings, []
        own = (self.counts - s.discount * self.sampled / len(sweeps)) / (s.concentration + np.append(self.corpus.customers, 0)[self.contexts])
        for i, self.guests, self.top in zip(sweeps, self.samples[::2], self.samples[1::2], strict=True):
            parent.append(self.word_probability(i))
        return own, np.stack(parent, axis=1)

    def word_probability(self, sweep: int) -> np.ndarray:
        return _parent(self.settings, self.corpus, sweep, self.guests, self.top)

    def step(self, sweep: int, tables: np.ndarray | None = None) -> None:
        """Sweep number ``sweep`` given the totals of the one before, and the tables of the live dishes' contexts after it."""
        s, t = self.settings, self.corpus.sweeps[sweep - 1]
        rng = np.random.default_rng([s.seed, self.bucket, sweep])
        chance = np.append(self.word_probability(sweep - 1), _parent(s, self.corpus, sweep - 1, t.hot_guests, t.hot_top))
        held = np.append(t.tables, 1.0)[self.contexts[self.several]]
        if len(self.live):
            held[self.contexts[self.several] == s.shared] = tables
        self.tables = np.ones(len(self.counts))
        self.tables[self.several] = gibbs_tables(None, self.counts[self.several], (s.concentration + s.discount * held) * chance[self.owner[self.several]], s.discount, rng)
        self.guests = np.bincount(self.owner, self.tables, self.owners)[: len(self.words)]
        self.top, several = np.ones(len(self.words)), np.flatnonzero(self.guests > 1)
        top = np.full(len(several), _top_weight(s, self.corpus, sweep - 1))
        self.top[several] = gibbs_tables(None, self.guests[several].astype(np.int64), top, s.word_discount, rng)

    def run(self, sweeps: int) -> Seating:
        for i in range(1, sweeps + 1):
            self.step(i)
        return self

    def model(self, sweeps: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Per pair the mean over samples of what its own restaurant gives, and words x samples the probability that the parent gives; made from the counts
        alone, where all contexts are frequent."""
        s, own, parent = self.settings, np.zeros(len(self.counts)), []
        done = 0
        for i in sweeps:
            while done < i:
                done += 1
                self.step(done)
            own += (self.counts - s.discount * self.tables) / (s.concentration + self.corpus.customers[self.contexts]) / len(sweeps)
            parent.append(self.word_probability(i))
        return own, np.stack(parent, axis=1)


def _top_weight(s: Settings, corpus: Corpus, sweep: int) -> float:
    return (s.word_concentration + s.word_discount * corpus.sweeps[sweep].top) / (corpus.words + 1)


def backoff(corpus: Corpus, s: Settings, sweeps: list[int]) -> np.ndarray:
    """Contexts x samples: the share that each frequent context leaves to its parent."""
    return np.stack([(s.concentration + s.discount * corpus.sweeps[i].tables) / (s.concentration + corpus.customers) for i in sweeps], axis=1)


#: What rows (bucket, (kind, from bucket, value)) hold: pairs, seats with the excess of the bucket's contexts in samples, sums, and what buckets send each other.
DATA, SEATS, SUMS, ASKED, TABLES, EXCESS = range(6)


def _place(bucket: int) -> int:
    return bucket


def _of_kinds(*kinds: int):
    return lambda rows: (r for r in rows if r[1][0] in kinds)


def _beside(first: RDD, *others: RDD) -> RDD:
    """Partitions side by side of tables dealt alike. ``RDD.union`` would send each through Python once more, to make batches alike that read alike anyway."""
    rows = first._jrdd
    for other in others:
        rows = rows.union(other._jrdd)
    return RDD(rows, first.ctx, first._jrdd_deserializer)


def _held(rows: Iterator[tuple]) -> dict[int, list[tuple[int, object]]]:
    """A bucket's rows by kind."""
    held: dict[int, list[tuple[int, object]]] = {kind: [] for kind in range(6)}
    for _, (kind, source, value) in rows:
        held[kind].append((source, value))
    return held


def _kept(held: dict[int, list[tuple[int, object]]]) -> tuple[bytes | None, list[bytes]]:
    """A bucket's seats so far and the excess of its contexts in each sample: (keys and) customers less tables."""
    seats, excess = held[SEATS][0][1] if held[SEATS] else (None, [])
    return seats, excess + [value for _, value in held[EXCESS]]


def _sweep(settings: Settings, corpus: Broadcast, sweep: int, sampled: bool):
    """Seats, sums and, for buckets of contexts that are not frequent, the excess of live dishes after one more sweep; sweep 0 is where all start."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        held = _held(rows)
        for bucket, data in held[DATA]:
            seats, excess = _kept(held)
            state = Seating(bucket, data, settings, corpus.value).sit(seats)
            keys, at, parts = state.asked()
            if sweep:
                tables, parts_of = np.zeros(len(keys)), dict(parts)
                for source, raw in held[TABLES]:
                    tables[parts_of[source]] = _unpack(raw)[0]
                state.step(sweep, tables[at])
            if sampled:
                state.take()
            over = np.bincount(at, (state.counts - state.tables)[state.live], len(keys)).astype(np.int64)
            yield bucket, (SEATS, bucket, (state.seats(), excess))
            yield bucket, (SUMS, bucket, state.sums(sweep == 0))
            for target, part in parts:
                yield target, (ASKED, bucket, _pack(over[part], *([] if sweep else [keys[part]])))

    return run


def _contexts(settings: Settings, corpus: Broadcast):
    """Of the contexts of a bucket that others ask for: hashes, customers, and which each bucket asks for. Customers of a context are the word's tokens."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        held = _held(rows)
        if not held[ASKED]:
            return
        ((bucket, data),) = held[DATA]
        state = Seating(bucket, data, settings, corpus.value)
        asked = {source: _unpack(raw)[1].astype(np.uint64) for source, raw in held[ASKED]}
        keys = np.unique(np.concatenate(list(asked.values())))
        customers = state.word_counts[np.searchsorted(state.words, keys)].astype(np.int64)
        sources = np.array(sorted(asked))
        yield bucket, (DATA, bucket, _pack(keys, customers, sources, *(np.searchsorted(keys, asked[b]) for b in sources.tolist())))

    return run


def _answer(sampled: bool, last: bool):
    """Tables of a bucket's contexts for every bucket that asks; after a sample their excess too, for the bucket itself."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        held = _held(rows)
        for bucket, raw in held[DATA]:
            keys, customers, sources, *places = _unpack(raw)
            at = dict(zip(sources.tolist(), places, strict=True))
            excess = np.zeros(len(keys), np.int64)
            for source, values in held[ASKED]:
                excess += np.bincount(at[source], _unpack(values)[0], len(keys)).astype(np.int64)
            tables = customers.astype(np.int64) - excess
            for source in sources.tolist() if not last else []:
                yield source, (TABLES, bucket, _pack(tables[at[source]]))
            if sampled:
                yield bucket, (EXCESS, bucket, _pack(excess, *([keys] if last else [])))

    return run


def _seated(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows (bucket, data, seats, shares): shares are contexts of the bucket and their excess in each sample, where there is any."""
    held = _held(rows)
    for bucket, data in held[DATA]:
        seats, excess = _kept(held)
        parts = [_unpack(raw) for raw in excess]
        yield bucket, data, seats, _pack(*([parts[-1][1]] if parts else []), *(p[0] for p in parts))


class PitmanYorModel:
    """Counts of (context, word) pairs by bucket of words and their last seats, written to the scratch folder, and the totals of every sweep."""

    def __init__(self, train: DataFrame, settings: Settings, burn_in: int = BURN_IN, samples: int = SAMPLES, text: str = "text") -> None:
        spark = train.sparkSession
        width = shuffle_width(spark)
        self.settings = settings
        settings.buckets = width
        texts = train.select(binary(text).alias("text"))
        self.frequent = _most_frequent(texts, settings)
        known, hot = spark.sparkContext.broadcast(self.frequent), len(self.frequent.words)
        counted = texts.mapInArrow(_count(known, width), PAIRS).rdd.map(lambda r: (r[0], bytes(r[1])))
        pairs = counted.partitionBy(width, _place).mapPartitions(_merge, preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
        self.corpus = Corpus(0, 0, np.zeros(settings.shared), [], np.zeros(hot))
        self.sweeps = list(range(burn_in + 1, burn_in + samples + 1))
        # Each sweep goes on from the seats of the one before, which are kept until the next has them; a lost part follows again from the counts. Buckets
        # send each other the totals of contexts that are not frequent: numbers without keys, in an order agreed on before the first sweep.
        last = asked = None
        state, end = pairs, burn_in + samples
        for sweep in range(end + 1):
            held = spark.sparkContext.broadcast(self.corpus)
            done = state.mapPartitions(_sweep(settings, held, sweep, sweep > burn_in), preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
            add = lambda x, y: [a + b for a, b in zip(x, y, strict=True)]
            nothing = [np.zeros(n) for n in (*[settings.shared] * (1 + (sweep == 0)), *[hot] * (1 + (sweep == 0)), 4)]
            tables, *more, (all_guests, top, tokens, words) = done.mapPartitions(_of_kinds(SUMS)).map(lambda r: r[1][2]).treeAggregate(nothing, add, add)
            guests, hot_top = more[-1 - (sweep == 0)], np.ones(hot)
            if sweep == 0:
                self.corpus = Corpus(int(tokens), int(words) + hot, more[0], [], more[2])
            elif hot:
                rng = np.random.default_rng([settings.seed, width, sweep])
                hot_top = gibbs_tables(None, guests.astype(np.int64), np.full(hot, _top_weight(settings, self.corpus, sweep - 1)), settings.word_discount, rng)
            totals = Totals(tables, all_guests + guests.sum(), top + hot_top.sum(), guests, hot_top)
            c = self.corpus
            self.corpus = Corpus(c.tokens, c.words, c.customers, [*c.sweeps, totals], c.hot_counts)
            state = _beside(pairs, done)
            if hot:
                over = done.mapPartitions(_of_kinds(ASKED)).partitionBy(width, _place)
                if sweep == 0:
                    asked = _beside(pairs, over).mapPartitions(_contexts(settings, held), preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
                answers = _beside(asked, over).mapPartitions(_answer(sweep > burn_in, sweep == end))
                state = _beside(state, answers.partitionBy(width, _place))
            assert state.getNumPartitions() == width
            if last is not None:
                last.unpersist()
            last = done
        self.seated = settle(spark.createDataFrame(state.mapPartitions(_seated), SEATED), "lm-seats")
        self.counts = self.seated.select("bucket", "data")
        for rows in (pairs, last, asked):
            if rows is not None:
                rows.unpersist()
        # What is left of the shuffles is not read again, and would stay on disk until the driver collects its garbage.
        state._jrdd.rdd().cleanShuffleDependencies(True)
        self.hot = self._hot()

    def _hot(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words (ids) with at least HOT of all tokens in order, their counts, and words x frequent contexts their probabilities."""
        settings, sweeps, least = self.settings, self.sweeps, HOT * self.corpus.tokens
        spark = self.seated.sparkSession
        held = spark.sparkContext.broadcast(self.corpus)
        homes = self.frequent.homes(np.arange(len(self.frequent.words), dtype=np.uint64), np.zeros(len(self.frequent.words), np.uint64), settings.buckets)

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b, raw, seats in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                    corpus, state = held.value, Seating(b, raw.as_py(), settings, held.value)
                    counts = np.append(state.word_counts, np.where(homes == b, corpus.hot_counts, 0))
                    if (counts < least).all():
                        continue
                    own, parent = state.sit(seats.as_py()).averaged(sweeps)
                    parent = np.concatenate([parent, _hot_parent(corpus, settings, sweeps)])
                    share = backoff(corpus, settings, sweeps)
                    ids, dense = np.append(state.words, np.arange(len(corpus.hot_counts), dtype=np.uint64)), state.contexts < settings.shared
                    words, table = [], []
                    for w in np.flatnonzero(counts >= least):
                        p = (share @ parent[w]) / len(sweeps)
                        mine = (state.owner == w) & dense
                        p[state.contexts[mine]] += own[mine]
                        words.append(w)
                        table.append(p.astype(np.float32).tobytes())
                    columns = [pa.array(ids[words].view(np.int64)), pa.array(counts[words]), pa.array(table, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["word", "count", "p"])

        got = self.seated.select("bucket", "data", "seats").mapInArrow(rows, "word bigint, count double, p binary").collect()
        words = np.array([r["word"] for r in got], np.int64).view(np.uint64)
        order = np.argsort(words)
        table = np.array([np.frombuffer(r["p"], np.float32) for r in got], np.float32).reshape(-1, settings.shared)
        return words[order], np.array([r["count"] for r in got])[order], table[order]

    def rows(self) -> DataFrame:
        """The model by bucket: what ``Known`` is made of."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b, *parts in zip(batch.column(0).to_pylist(), *(batch.column(i) for i in (1, 2, 3)), strict=True):
                    parts = [p.as_py() for p in parts]
                    data = struct.pack("<2q", len(parts[0]), len(parts[1])) + b"".join(parts)
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([data], pa.binary())], names=["bucket", "data"])

        return self.seated.mapInArrow(run, PAIRS)


def _hot_parent(corpus: Corpus, s: Settings, sweeps: list[int]) -> np.ndarray:
    return np.stack([_parent(s, corpus, i, corpus.sweeps[i].hot_guests, corpus.sweeps[i].hot_top) for i in sweeps], axis=1)


class Known:
    """What a bucket's task knows to score by: its words and those dealt by context, its pairs, and its words as contexts that are not frequent."""

    def __init__(self, raw: bytes | None, settings: Settings, corpus: Corpus, sweeps: list[int]) -> None:
        none = np.zeros(0, np.uint64)
        raw = raw or struct.pack("<2q", 0, 0)
        n, m = struct.unpack_from("<2q", raw)
        state = Seating(0, raw[16 : 16 + n] or _pack_pairs(none, none, none, none), settings, corpus)
        state.sit(raw[16 + n : 16 + n + m] or _pack(*[none] * (3 + 2 * len(sweeps))))
        self.settings, self.sweeps, hot = settings, sweeps, len(corpus.hot_counts)
        self.keys, self.customers = state.words, state.word_counts
        asked, *excess = (_unpack(raw[16 + n + m :]) if len(raw) > 16 + n + m else []) or [none]
        self.asked, self.excess = asked.astype(np.uint64), np.stack([e.astype(float) for e in excess] or [np.zeros(len(asked))] * len(sweeps), axis=1)
        self.words = np.concatenate([np.arange(hot, dtype=np.uint64), state.words])
        self.counts = np.concatenate([corpus.hot_counts, state.word_counts]).astype(np.int64)
        self.guests = np.stack([np.concatenate([corpus.sweeps[i].hot_guests, g]) for i, g in zip(sweeps, state.samples[::2], strict=True)], axis=1)
        self.top = np.stack([np.concatenate([corpus.sweeps[i].hot_top, g]) for i, g in zip(sweeps, state.samples[1::2], strict=True)], axis=1)
        self.parent = np.stack([_parent(settings, corpus, i, self.guests[:, j], self.top[:, j]) for j, i in enumerate(sweeps)], axis=1)
        rank = np.where(state.owner < len(state.words), state.owner + hot, state.owner - len(state.words))
        customers = np.append(corpus.customers, 0)[state.contexts]
        rare = np.flatnonzero(state.contexts == settings.shared)
        customers[rare] = self._customers(state.context_ids[rare])
        code = _code(rank, state.context_ids)
        order = np.argsort(code)
        self.code, self.pair_counts, self.sampled = code[order], state.counts[order].astype(np.int32), state.sampled[order].astype(np.int32)
        self.own = ((state.counts - settings.discount * state.sampled / len(sweeps)) / (settings.concentration + customers))[order]

    def _customers(self, keys: np.ndarray) -> np.ndarray:
        at, found = _find(self.keys, keys)
        return np.where(found, self.customers[at], 0) if len(self.keys) else np.zeros(len(keys))

    def contexts(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Customers, and contexts x samples tables, of contexts of this bucket; none of those that no training text has."""
        customers = self._customers(keys)
        at, found = _find(self.asked, keys)
        excess = np.where(found[:, None], self.excess[at], 0) if len(self.asked) else 0
        return customers, np.maximum(customers[:, None] - excess, np.zeros(len(self.sweeps)))


def _code(rank: np.ndarray, context: np.ndarray) -> np.ndarray:
    """A hash of a pair, of a word's place and a context's id."""
    return mix64(mix64(context) + rank.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _share(s: Settings, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
    return (s.concentration + s.discount * tables) / (s.concentration + customers)[:, None]


def _base(counts: np.ndarray, corpus: Corpus) -> np.ndarray:
    return np.log10((counts + 0.1) / (corpus.tokens + 0.1 * (corpus.words + 1)))


def _read(settings: Settings, corpus: Broadcast, frequent: Broadcast, hot: Broadcast):
    """Rows (bucket, kind, part, data): a part's documents with what its hot words score (2), and for every bucket the other words with contexts and texts (1).
    Where neither word nor context is a frequent one, the bucket of the context is asked about it too (3)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent.value
        tokens = Tokens(known)
        words, counts, table = hot.value
        logs = np.log10(table)
        base = _base(counts, corpus.value)
        for batch in batches:
            keys, at = batch.select(["key", "held_out"]), 0
            for chunk in text_chunks(batch.column("text"), CHUNK):
                own, n = keys.slice(at, len(chunk)), len(chunk)
                at += n
                token, context, text = tokens.read(chunk)
                totals = np.bincount(text, minlength=n)
                place, is_hot = _find(words, token)
                is_hot &= context < LEAST
                t, h = text[is_hot], place[is_hot]
                sums = [np.bincount(t, x, n) for x in (np.ones(len(t)), base[h], logs[h, context[is_hot].astype(np.int64)])]
                token, context, text = (x[~is_hot] for x in (token, context, text))
                order = np.lexsort((text, token))
                token, context, text = token[order], context[order], text[order]
                home = known.homes(token, context, settings.buckets)
                bucket, data = _dealt(token, context, home, text)
                both = np.flatnonzero((token >= LEAST) & (context >= LEAST))
                both = both[np.argsort(home[both], kind="stable")]
                asked, place = np.unique(context[both], return_inverse=True)
                # Such a context is a word that its bucket is sent anyway, but where that word is scored here: its place among those is enough.
                sent = token[_runs(token)[0]]
                sent = sent[sent >= LEAST]
                spot, found = _find(sent, asked)
                of = _bucket(sent, settings.buckets)
                order = np.argsort(of, kind="stable")
                first = np.searchsorted(of[order], np.arange(settings.buckets))
                number = np.empty(len(sent), np.int64)
                number[order] = np.arange(len(sent)) - first[of[order]]
                of = _bucket(asked, settings.buckets)
                order = np.lexsort((~found, of))
                rank = np.empty(len(asked), np.int64)
                rank[order] = np.arange(len(asked))
                kinds = [1] * len(data)
                for f, k in zip(*_runs(of[order]), strict=True):
                    part = order[f : f + k]
                    bucket.append(int(of[part[0]]))
                    data.append(_pack(number[spot[part[found[part]]]], asked[part[~found[part]]]))
                    kinds.append(3)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, own.schema) as writer:
                    writer.write_batch(own)
                head = struct.pack("<q", sink.getvalue().size) + sink.getvalue().to_pybytes() + _pack(totals, *sums, text[both], rank[place])
                # Of all that is sent: only equal chunks share an id, and a task that runs again gives the same.
                part = int(mix64(np.array([_digest(b"".join([head, *data]))], np.uint64))[0] >> np.uint64(1))
                bucket.append(part % settings.buckets)
                data.append(head)
                kinds.append(2)
                columns = [pa.array(bucket, pa.int32()), pa.array(kinds, pa.int32()), pa.array([part] * len(data), pa.int64()), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "kind", "part", "data"])

    return run


def _digest(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little")


def _score(settings: Settings, corpus: Broadcast, sweeps: list[int]):
    """The model row of a bucket comes first, then parts one after the other. A row (part, kind, data) with sums per text for each part (1), and where neither word
    nor context is a frequent one, what the bucket knows of the pair and its word (3), or of the context (4), token by token, to be met in the part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = backoff(corpus.value, settings, sweeps) / len(sweeps)
        raw, model, own = None, None, np.zeros(0, np.uint64)
        unseen_top = np.array([_unseen(corpus.value, settings, i) for i in sweeps])

        def add(bucket: int, data: bytes) -> tuple[bytes, bytes | None, np.ndarray]:
            seen, sizes, ids, (texts,) = _unpack_pairs(data)
            at, known = _find(model.words, seen)
            if len(model.words):
                count, top = np.where(known, model.counts[at], 0), np.where(known[:, None], model.parent[at], unseen_top)
            else:
                count, top = np.zeros(len(seen), np.int64), np.tile(unseen_top, (len(seen), 1))
            owner = np.repeat(np.arange(len(seen)), sizes)
            place, paired = _find(model.code, _code(at[owner], ids))
            paired &= known[owner]
            rare = ids >= LEAST
            both = rare & (seen >= LEAST)[owner]
            rare &= ~both
            left = np.zeros((len(ids), len(sweeps)))
            left[~(rare | both)] = share[ids[~(rare | both)].astype(np.int64)]
            left[rare] = _share(settings, *model.contexts(ids[rare])) / len(sweeps)
            p = np.einsum("ij,ij->i", left, top[owner])
            if len(model.code):
                p += np.where(paired, model.own[place], 0)
            p[both] = 1
            which = np.flatnonzero(np.bincount(texts))
            values = (np.bincount(texts, x)[which] for x in (known[owner], _base(count, corpus.value)[owner], np.log10(p)))
            sums = _pack(which, *(v.astype(np.int64) if i == 0 else v for i, v in enumerate(values)))
            if not both.any():
                return sums, None, seen[seen >= LEAST]
            seated, of, pair = known[owner][both], at[owner][both], paired[both]
            columns = [np.where(pair, x[place[both]], 0) for x in (model.pair_counts, model.sampled)] if len(model.code) else [np.zeros(len(of), np.int64)] * 2
            for x in (model.guests, model.top):
                columns += [np.where(seated, x[of, j], 0).astype(np.int64) if len(x) else np.zeros(len(of), np.int64) for j in range(len(sweeps))]
            return sums, _pack(np.array([bucket]), *columns), seen[seen >= LEAST]

        for batch in batches:
            out = []
            for b, kind, part, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                data = value.as_py()
                if kind == 0:
                    raw = data
                    continue
                if model is None:
                    model, raw = Known(raw, settings, corpus.value, sweeps), None
                if kind == 2:
                    out.append((part, data, 2))
                elif kind == 3:
                    places, others = _unpack(data)
                    customers, tables = model.contexts(np.concatenate([own[places], others.astype(np.uint64)]))
                    out.append((part, _pack(np.array([b]), customers.astype(np.int64), *tables.T.astype(np.int64)), 4))
                else:
                    sums, pairs, own = add(b, data)
                    out += [(part, sums, 1)] + ([(part, pairs, 3)] if pairs else [])
            if out:
                yield _parts(out)

    return run


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    part, data, kind = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], names=["part", "kind", "data"])


def _unseen(corpus: Corpus, s: Settings, sweep: int) -> float:
    return _parent(s, corpus, sweep, np.zeros(1), np.zeros(1))[0]


def _by_bucket(rows: list[bytes]) -> list[np.ndarray]:
    """Columns of rows that start with their bucket, one after the other in its order. Rows of equal chunks are equal and count once."""
    found = {int(columns[0][0]): columns[1:] for columns in map(_unpack, rows)}
    return [np.concatenate(c).astype(float) for c in zip(*(found[b] for b in sorted(found)), strict=True)]


def _met(pairs: list[np.ndarray], contexts: list[np.ndarray], asked: np.ndarray, settings: Settings, corpus: Corpus, sweeps: list[int]) -> np.ndarray:
    """Logarithms of the probabilities of words after contexts where neither is a frequent one."""
    counts, sampled, *seats = pairs
    customers, *tables = (c[asked] for c in contexts)
    p = (counts - settings.discount * sampled / len(sweeps)) / (settings.concentration + customers)
    share = _share(settings, customers, np.stack(tables, axis=1))
    for j, i in enumerate(sweeps):
        p += share[:, j] * _parent(settings, corpus, i, seats[j], seats[len(sweeps) + j]) / len(sweeps)
    return np.log10(p)


def _gather(settings: Settings, corpus: Broadcast, sweeps: list[int]):
    """Documents of each part: what its head says, plus the sums that come from every partition, and the tokens that two buckets told about. Equal chunks are one
    part with a head each, and their sums have been added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for p, kind, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if p != part and held:
                    yield from result(held)
                    held = []
                part = p
                held.append((kind, raw.as_py()))
        if held:
            yield from result(held)

    def result(rows: list[tuple[int, bytes]]) -> list[pa.RecordBatch]:
        heads = [raw for kind, raw in rows if kind == 2]
        head, copies = heads[0], len(heads)
        size = struct.unpack_from("<q", head)[0]
        own = pa.ipc.open_stream(head[8 : 8 + size]).read_next_batch()
        totals, known, base, score, texts, asked = _unpack(head[8 + size :])
        n, known, base, score = len(totals), known.copy(), base.copy(), score.copy()
        for kind, raw in rows:
            if kind == 1:
                touched, k, b, s = _unpack(raw)
                known[touched] += k / copies
                base[touched] += b / copies
                score[touched] += s / copies
        if len(texts):
            met = _met(*(_by_bucket([raw for kind, raw in rows if kind == k]) for k in (3, 4)), asked, settings, corpus.value, sweeps)
            score += np.bincount(texts, met, n)
        columns = [
            own.column("key"),
            own.column("held_out"),
            pa.array(totals.astype(np.int64)),
            pa.array(np.rint(known).astype(np.int64)),
            pa.array(np.full(n, corpus.value.tokens, np.int64)),
            pa.array(base),
            pa.array(score),
        ]
        return [pa.RecordBatch.from_arrays(columns, names=["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])] * copies

    return run


def score_texts(docs: DataFrame, held_out: Column, settings: Settings | None = None, burn_in: int = BURN_IN, samples: int = SAMPLES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``, the model learned from rows not held out.

    Tokens are words between ASCII whitespace with A-Z lower-cased, then one end. The model: a token's customers sit in the restaurant of
    the word before it (every word has one, and so has the start of a text), each table sends a guest to the one restaurant above, and
    its tables draw from all words and one unknown alike. Sweeps of Gibbs steps sample the tables of every pair and word;
    probabilities are averaged over ``samples`` sweeps after ``burn_in``. Perplexity is 10 ** (-sum(score) / sum(n_tokens)).

    Restaurants couple through totals only. Within a sweep each task takes those of the sweep before, so buckets of words are sampled
    side by side. Totals of the ``settings.shared`` most frequent contexts are one small aggregate. Those of any other context are added up where the bucket of
    that word is, and buckets are told those that they need: pairs seen once have one table, so only the others count. Seats are kept from one sweep to the
    next, so that work grows with the number of sweeps; they follow from counts, seed and totals, so lost tasks are just made again. Pairs of the
    ``settings.split`` most frequent words are dealt by context, unless that is a frequent one too. Words with HOT of all tokens are scored where they are read
    after a frequent context, by a table of at most 1 / HOT words x ``settings.shared``; all other tokens are sent, compressed and by bucket, to where the model of
    the pair is. Of a token that is no frequent word after another, two buckets tell what they know, and the scored texts' task puts it together.

    Null text: empty, one token (the end). Null key: passed through. Repeated rows score alike. An empty table gives an empty result, no training rows
    a model without words. Words are told apart by 64-bit hashes. Other columns are not looked at.
    """
    settings = settings or Settings()
    spark = docs.sparkSession
    out = F.coalesce(held_out, F.lit(False))
    model = PitmanYorModel(docs.where(~out), settings, burn_in, samples, text)
    corpus, frequent, hot = (spark.sparkContext.broadcast(x) for x in (model.corpus, model.frequent, model.hot))
    kind = docs.select(F.col(f"`{key}`").alias("key")).schema["key"].dataType.simpleString()
    rows = docs.select(F.col(f"`{key}`").alias("key"), out.alias("held_out"), binary(text).alias("text"))
    sent = rows.mapInArrow(_read(settings, corpus, frequent, hot), "bucket int, kind int, part bigint, data binary")
    known = model.rows().select("bucket", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("part"), "data")
    width = shuffle_width(spark)
    met = known.unionByName(sent).repartitionById(width, "bucket").withColumn("first", F.least("kind", F.lit(1))).sortWithinPartitions("first", "part", "kind")
    scored = met.select("bucket", "kind", "part", "data").mapInArrow(_score(settings, corpus, model.sweeps), "part bigint, kind int, data binary")
    fields = f"key {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    done = scored.repartition(width, "part").sortWithinPartitions("part").mapInArrow(_gather(settings, corpus, model.sweeps), fields)
    return done.withColumnRenamed("key", key)
