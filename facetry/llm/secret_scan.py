"""Secret scans: fixed patterns, and strings in a sensitive context that a compressor primed with the corpus' words and the code around cannot shorten."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary, text_chunks

#: Words of the dictionary at most, and texts that must hold a word of it.
DICTIONARY_WORDS, LEAST_TEXTS = 4096, 5
#: Bytes before and after a candidate that count as the code around it, and bytes after a sensitive word in which a candidate must begin.
AROUND, REACH = 512, 64
#: A candidate is novel from this many marginal bytes per byte of it, and this many marginal bytes, on.
LEAST_RATIO, LEAST_BYTES = 0.7, 8
LEVEL = 9

# The patterns of the base kinds, least lengths, and words that make a context sensitive.
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(rb"[0-9a-f]{24,}")
_ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "novel")
_SENSITIVE = re.compile(
    rb"pass(?:word|wd|phrase|code)|pwd|secret|token|credential|(?:api|access|private|secret|encryption|signing)[ _-]?key|bearer|\bauth\b|authorization"
    rb"|signature|session[ _-]?id|cookie|login",
    re.IGNORECASE,
)
_CANDIDATE = re.compile(rb"[A-Za-z0-9+/_.-]{10,}={0,2}")
_MIXED = re.compile(rb"[0-9]|[a-z][A-Z]")
# Words of one case pattern that stand alone: a secret mixes cases or holds digits and signs.
_WORD = re.compile(rb"(?<![0-9A-Za-z+/=.-])(?:[A-Z]?[a-z]{2,23}|[A-Z]{3,24})(?![0-9A-Za-z+/=-])")

SPAN = "struct<kind:string,start:bigint,end:bigint,value:string,marginal:bigint,novelty:double>"
RESULT = f"spans array<{SPAN}>, redacted string"


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): in how many rows each stand-alone word of letters occurs, over all rows and whole texts. Chunks are counted before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch.column("text")):
                held: Counter[bytes] = Counter()
                for raw in chunk:
                    held.update(set(_WORD.findall(raw)))
                yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    return docs.select(binary(text).alias("text")).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def identifier_dictionary(docs: DataFrame, text: str = "text", size: int = DICTIONARY_WORDS, least: int = LEAST_TEXTS) -> bytes:
    """The commonest words of the table, rarest first, separated by spaces: at most ``size`` words, whatever the table's size.

    Words are ranked by powers of two of their number of rows, and the last power that fits ``size`` as a whole is the last that enters, so that no
    task has to sort the vocabulary. Empty tables and tables without a word in ``least`` rows give an empty dictionary.
    """
    counts = word_counts(docs, text).where(F.col("n") >= least).withColumn("power", F.floor(F.log2("n")).cast("int")).persist()
    try:
        fits, total = None, 0
        for power, words in sorted(((r[0], r[1]) for r in counts.groupBy("power").count().collect()), reverse=True):  # at most 63 rows
            total += words
            if total > size:
                break
            fits = power
        if fits is None:
            return b""
        rows = counts.where(F.col("power") >= fits).select("n", "word").collect()  # at most ``size`` rows of at most 24 letters
    finally:
        counts.unpersist()
    return " ".join(r.word for r in sorted(rows, key=lambda r: (r.n, r.word))).encode()


@dataclass
class NoveltyScanner:
    """Spans of one text after another. ``dictionary`` primes the compressor; so does the code around a candidate."""

    dictionary: bytes
    ratio: float = LEAST_RATIO
    least: int = LEAST_BYTES

    def __post_init__(self) -> None:
        primed = zstandard.ZstdCompressionDict(self.dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(self.dictionary) >= 8 else None
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=primed, write_checksum=False, write_content_size=False)

    def marginal(self, raw: bytes, start: int, end: int) -> int:
        """Bytes that the candidate adds to the compressed code around it. Other occurrences of the candidate there do not count."""
        value = raw[start:end]
        around = raw[max(0, start - AROUND) : start].replace(value, b"") + b"\n" + raw[end : end + AROUND].replace(value, b"") + b"\n"
        size = self.compressor.compress
        return max(0, len(size(around + value)) - len(size(around)))

    def spans(self, raw: bytes) -> list[tuple[int, int, int, int, int]]:
        """(start, kind, end, start of the value, marginal bytes) in bytes, in order of start and kind."""
        found = []
        for m in _ASSIGN.finditer(raw):
            if m.end(2) - m.start(2) >= _ASSIGN_LEAST:
                found.append((m.start(), 0, m.end(), m.start(2)))
        found += [(m.start(), 1, m.end(), m.start()) for m in _ACCESS.finditer(raw)]
        found += [(m.start(), 2, m.end(), m.start()) for m in _HEX.finditer(raw)]
        out = [(*span, self.marginal(raw, span[3], span[2])) for span in found]
        covered = sorted((s, e) for s, _, e, _ in found)
        at, reached = 0, 0
        for start, end in self._candidates(raw):
            while at < len(covered) and covered[at][0] < end:
                reached = max(reached, covered[at][1])
                at += 1
            if reached > start:  # part of a base span
                continue
            cost = self.marginal(raw, start, end)
            if cost >= self.least and cost >= self.ratio * (end - start):
                out.append((start, 3, end, start, cost))
        return sorted(out)

    @staticmethod
    def _candidates(raw: bytes) -> Iterator[tuple[int, int]]:
        """Strings of ten or more letters, digits and joining signs that begin shortly after a sensitive word on its line; each once, in order."""
        done = 0
        for word in _SENSITIVE.finditer(raw):
            stop = word.end() + REACH
            line = raw.find(b"\n", word.end(), stop)
            stop = line if line >= 0 else stop
            at = max(done, word.end())
            while at < stop:
                m = _CANDIDATE.search(raw, at, min(len(raw), stop + 10))
                if m is None or m.start() >= stop:
                    break
                m = _CANDIDATE.match(raw, m.start())  # to its own end, which may lie beyond
                end = m.end()
                while raw[end - 1] in b"._-":
                    end -= 1
                if end - m.start() >= 10 and _MIXED.search(raw, m.start(), end):
                    yield m.start(), end
                at = done = m.end()


def _code_points(raw: bytes, places: list[int]) -> dict[int, int]:
    """Code points before each byte offset, in one pass over the text."""
    out, at, n = {}, 0, 0
    for place in sorted(set(places)):
        n += len(raw[at:place].decode("utf-8", "replace"))
        out[place], at = n, place
    return out


def scan_text(scanner: NoveltyScanner, raw: bytes, redact: bool) -> dict:
    spans = scanner.spans(raw)
    points = _code_points(raw, [p for s in spans for p in (s[0], s[2])])
    rows = [
        {
            "kind": KINDS[kind],
            "start": points[start],
            "end": points[end],
            "value": raw[value:end].decode("utf-8", "replace"),
            "marginal": cost,
            "novelty": cost / (end - value),
        }
        for start, kind, end, value, cost in spans
    ]
    cleaned = None
    if redact and spans:
        parts, at = [], 0
        for value, end in sorted((s[3], s[2]) for s in spans):
            if end > at:
                parts += [raw[at : max(at, value)], b"[secret]" if value >= at else b""]
                at = end
        cleaned = b"".join([*parts, raw[at:]]).decode("utf-8", "replace")
    return {"spans": rows, "redacted": cleaned}


def scan_secrets(docs: DataFrame, dictionary: bytes, text: str = "text", into: str = "secret_scan", redact: bool = False, ratio: float = LEAST_RATIO) -> DataFrame:
    """``docs`` with a struct ``into``: ``spans`` (kind, start and end in code points, the secret's own text, marginal compressed bytes, these per
    byte), and with ``redact`` the text with every secret replaced, where there is one.

    Kinds ``assign``, ``access`` and ``hex`` are the patterns; ``novel`` are strings of ten or more signs with a digit or an inner change of case that
    begin within 64 bytes after a sensitive word of their line, overlap no pattern's span, and are incompressible: what they add to the compressed size of the code around them
    (512 bytes on both sides, behind the ``dictionary``) is at least ``ratio`` of their length. A map over rows: null and empty texts have no spans,
    rows are independent, repeated rows give repeated results, and other columns pass through (a column named ``into`` is replaced).
    """

    @F.pandas_udf(f"struct<{RESULT.replace(' array', ':array').replace(' string', ':string')}>")
    def scan(texts):
        import pandas as pd

        scanner = NoveltyScanner(dictionary, ratio)
        rows = [scan_text(scanner, raw or b"", redact) for raw in texts]
        return pd.DataFrame({"spans": [r["spans"] for r in rows], "redacted": [r["redacted"] for r in rows]})

    return docs.withColumn(into, scan(binary(text)))


def joined_spans(spans: Column, kinds: tuple[str, ...]) -> Column:
    """Spans of some kinds as text, kind:start:end and commas."""
    held = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(held, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
