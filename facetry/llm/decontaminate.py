"""Benchmark decontamination: a broadcast set of test word windows, matched against the windows of every document."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FOLD, binary, text_chunks

#: Words of all benchmark items together that are broadcast; a larger benchmark has to come in parts.
MAX_WORDS = 20_000_000
WINDOW = 10
# Fixed value: bytes of words after lower-casing A-Z; all others separate.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

RESULT = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<start:bigint,end:bigint>>, cleaned string"


@dataclass
class Windows:
    """The distinct windows of one length: their hashes in order, their word numbers, and for each the items that hold it."""

    length: int
    hashes: np.ndarray
    words: np.ndarray
    items: list[list[str]]


def _factors(n: int) -> np.ndarray:
    return np.random.default_rng(12345).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _hash(columns: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(columns[0]), np.uint64)
    for column, factor in zip(columns, _factors(len(columns)), strict=True):
        out += (column.astype(np.uint64) + np.uint64(1)) * factor
    return out


class WindowIndex:
    """Windows of all items: ``width`` consecutive words each; an item of fewer, but not none, is one window."""

    def __init__(self, items: list[tuple[str, bytes]], width: int = WINDOW) -> None:
        self.vocabulary: dict[bytes, int] = {}
        found: dict[int, dict[tuple[int, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
        for name, raw in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in raw.translate(FOLD).split()]
            n = min(width, len(ids))
            for at in range(len(ids) - n + 1 if n else 0):
                found[n][tuple(ids[at : at + n])].add(name)
        self.windows = []
        for n, rows in sorted(found.items()):
            words = np.array(list(rows), np.int32).reshape(-1, n)
            hashes = _hash([words[:, i] for i in range(n)])
            order = np.argsort(hashes, kind="stable")
            names = [sorted(v) for v in rows.values()]
            self.windows.append(Windows(n, hashes[order], words[order], [names[i] for i in order]))

    def matches(self, ids: np.ndarray):
        """(start, length, window) of every occurrence in a sequence of word numbers, 0 for words of no item and between texts."""
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        for w in self.windows:
            at = np.flatnonzero(known[w.length :] - known[: -w.length] == w.length) if len(ids) >= w.length else np.zeros(0, np.int64)
            hashes = _hash([ids[at + i] for i in range(w.length)])
            low, high = np.searchsorted(w.hashes, hashes, "left"), np.searchsorted(w.hashes, hashes, "right")
            for i in np.flatnonzero(high > low):
                for j in range(low[i], high[i]):  # equal hashes are verified word by word
                    if np.array_equal(ids[at[i] : at[i] + w.length], w.words[j]):
                        yield int(at[i]), w.length, w.items[j]

    def scan(self, chunk: list[bytes], clean: bool) -> list[dict]:
        get = self.vocabulary.get
        ids, ends = [], []
        for raw in chunk:
            ids += [get(w, 0) for w in raw.translate(FOLD).split()]
            ends.append(len(ids))
            ids.append(0)
        ids, ends = np.array(ids, np.int32), np.array(ends)
        starts = np.concatenate([[0], ends[:-1] + 1])
        change, items = np.zeros(len(ids) + 1, np.int64), defaultdict(set)
        for at, length, names in self.matches(ids):
            change[at] += 1
            change[at + length] -= 1
            items[int(np.searchsorted(ends, at, "right"))].update(names)
        hit = np.cumsum(change[:-1]) > 0
        totals = np.concatenate([[0], np.cumsum(hit)])
        n_hit = totals[ends] - totals[starts]
        out = []
        for i, raw in enumerate(chunk):
            names, spans, cleaned = sorted(items.get(i, ())), [], None
            if n_hit[i]:
                spans = _spans(raw, hit[starts[i] : ends[i]])
                cleaned = _without(raw, spans).decode("utf-8", "replace") if clean else None
            out.append(
                {
                    "n_words": int(ends[i] - starts[i]),
                    "n_hit": int(n_hit[i]),
                    "n_items": len(names),
                    "items_sha256": hashlib.sha256(",".join(names).encode()).hexdigest(),
                    "contaminated": bool(n_hit[i]),
                    "items": names,
                    "spans": [{"start": s, "end": e} for s, e in spans],
                    "cleaned": cleaned,
                }
            )
        return out


def _spans(raw: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges of runs of hit words."""
    spans: list[list[int]] = []
    before = False
    for word, is_hit in zip(_WORD.finditer(raw.lower()), hit, strict=True):
        if is_hit and before:
            spans[-1][1] = word.end()
        elif is_hit:
            spans.append([word.start(), word.end()])
        before = bool(is_hit)
    return [(s, e) for s, e in spans]


def _without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for span in spans for x in span), len(raw)]
    return b"".join(raw[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True))


def window_index(benchmark: DataFrame, width: int = WINDOW, item: str = "item_id", text: str = "text") -> WindowIndex:
    """The windows of a benchmark table, whose size is checked before it is fetched. Null texts have no words; a null id is named ``null``."""
    body = F.col(f"`{text}`")
    words = benchmark.agg(F.sum(F.regexp_count(body, F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")))).first()[0] or 0
    if words > MAX_WORDS:
        raise ValueError(f"{words} benchmark words are more than {MAX_WORDS}; decontaminate against parts of the benchmark in turn")
    rows = benchmark.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("null")), binary(text)).collect()
    return WindowIndex([(r[0], bytes(r[1] or b"")) for r in rows], width)


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, clean: bool = False, text: str = "text", name: str = "contamination", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The table with a struct column of results per row.

    A document word is hit if it lies inside any occurrence of a window of ``width`` words of an item. Fields: counts of words, hit words and items
    with occurring windows, those items and a digest of them, whether any word is hit, byte ranges of runs of hit words in the UTF-8 text,
    and with ``clean`` the text without those ranges (null where nothing is hit).

    The set is a hash lookup in every task, so documents are neither shuffled nor joined. Null or empty text: no words. Repeated rows and any
    other columns pass through; an existing column called ``name`` is replaced. An empty benchmark hits nothing.
    """
    spark: SparkSession = docs.sparkSession
    index = spark.sparkContext.broadcast(window_index(benchmark, width, item, item_text))

    @F.arrow_udf(RESULT)
    def scan(texts: pa.Array) -> pa.Array:
        out = []
        for chunk in text_chunks(texts):
            out += index.value.scan(chunk, clean)
        return pa.array(out, ARROW)

    return docs.withColumn(name, scan(binary(text)))


ARROW = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("n_items", pa.int64()),
        ("items_sha256", pa.string()),
        ("contaminated", pa.bool_()),
        ("items", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("cleaned", pa.string()),
    ]
)


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", width: int = WINDOW, text: str = "text") -> DataFrame:
    """The table without contaminated documents, or with hit words cut out of their texts (``remove="spans"``); all columns kept."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove documents or spans")
    found = contamination(docs, benchmark, width, remove == "spans", text, "__contamination")
    if remove == "documents":
        return found.where(~F.col("__contamination.contaminated")).drop("__contamination")
    return found.withColumn(text, F.coalesce(F.col("__contamination.cleaned"), F.col(f"`{text}`"))).drop("__contamination")
