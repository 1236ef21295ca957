"""Language identification by cross-parsing: how few phrases of a language's labelled text does a text take."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import binary, text_chunks

#: Labelled text of a language that its automaton is built from: the first characters of so many documents, those with the smallest hash of the key.
TRAIN_DOCS, TRAIN_CHARS = 200, 200
#: Different letters that are told apart, the most frequent of the labelled text; all others match nothing.
ALPHABET = 96
#: Letters after which a phrase ends anyhow, alike for every language, so that long texts are parsed side by side.
PIECE = 512
#: Bytes of all automata together.
MAX_BYTES = 512 << 20


def suffix_automaton(symbols: list[int], alphabet: int) -> np.ndarray:
    """Transitions (states x alphabet, -1: none) of the automaton that accepts the substrings of a sequence; the root is state 0.

    Built on line: each symbol adds a state that stands for the whole prefix, and splits a state where a shorter suffix gets new right contexts.
    """
    moves: list[dict[int, int]] = [{}]
    length, link, last = [0], [-1], 0
    for c in symbols:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                split = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = split
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = split
                    p = link[p]
        last = new
    table = np.full((len(moves), alphabet), -1, np.int32)
    for state, row in enumerate(moves):
        table[state, list(row)] = list(row.values())
    return table


@dataclass
class LanguageModel:
    """Symbol of every code point (0: no letter), and for every language its automaton, one after the other in ``table``."""

    languages: list[str]
    symbols: np.ndarray
    alphabet: int
    tables: list[np.ndarray]
    sizes: list[int]

    @classmethod
    def fit(cls, texts: dict[str, list[str]]) -> LanguageModel:
        letters: Counter[str] = Counter()
        texts = {name: [t.lower() for t in some] for name, some in texts.items()}
        for some in texts.values():
            for text in some:
                letters.update(c for c in text if unicodedata.category(c)[0] == "L")
        known = {c: i + 1 for i, (c, _) in enumerate(sorted(letters.items(), key=lambda x: (-x[1], x[0]))[:ALPHABET])}
        alphabet = len(known) + 2  # also the gap between words, and letters not seen
        symbols = np.zeros(0x110000, np.uint8)
        for point in range(0x110000):
            c = chr(point)
            if unicodedata.category(c)[0] == "L":
                symbols[point] = known.get(c.lower(), alphabet - 1)
        model = cls([], symbols, alphabet, [], [])
        for name in sorted(texts):
            line = model.encode(["\n".join(texts[name])])[0]
            if (line > 0).any():
                line = line[line < alphabet - 1]
                model.languages.append(name)
                model.tables.append(suffix_automaton(line.tolist(), alphabet).ravel())
                model.sizes.append(len(line))
        if sum(t.nbytes for t in model.tables) > MAX_BYTES:
            raise ValueError(f"automata of {len(model.languages)} languages take more than {MAX_BYTES} bytes; learn from less text")
        return model

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of several texts, each with one gap before it and for each run of other characters, and where each text ends."""
        joined = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "replace"), np.uint32)
        symbols = self.symbols[joined]
        ends = np.cumsum([len(t) + 1 for t in texts])
        keep = np.concatenate([[True], (symbols[1:] > 0) | (symbols[:-1] > 0)])
        keep[ends] = True
        kept = np.cumsum(keep)
        return symbols[keep][:-1], np.append(0, kept[ends] - 1)

    def phrases(self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Number of longest matches that each piece is cut into; pieces come in order of falling size and take their steps together."""
        state, count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        active = len(starts)
        for step in range(int(sizes[0]) if len(sizes) else 0):
            while active and sizes[active - 1] <= step:
                active = int(np.searchsorted(-sizes, -step, "left"))
            c = symbols[starts[:active] + step].astype(np.int64)
            at = state[:active]
            to = table[at * self.alphabet + c]
            count[:active] += (to < 0) | (at == 0)
            state[:active] = np.where(to < 0, np.maximum(table[c], 0), to)
        return count

    def predict(self, chunk: list[bytes]) -> tuple[list[str], np.ndarray]:
        """Language and margin of each text: 1 - fewest / second fewest normalised phrases; ``und`` and 0 without a letter."""
        symbols, bounds = self.encode([t.decode("utf-8", "replace") for t in chunk])
        n = np.diff(bounds)
        letters = np.concatenate([[0], np.cumsum(symbols > 0)])
        lettered = letters[bounds[1:]] > letters[bounds[:-1]]
        pieces = np.where(lettered, -(-n // PIECE), 0)
        owner = np.repeat(np.arange(len(n)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = bounds[:-1][owner] + nth * PIECE
        sizes = np.minimum(PIECE, bounds[1:][owner] - starts)
        order = np.argsort(-sizes, kind="stable")
        costs = np.zeros((len(n), len(self.languages)))
        for i, table in enumerate(self.tables):
            count = self.phrases(symbols, starts[order], sizes[order], table)
            costs[:, i] = np.bincount(owner[order], count, len(n)) * np.log2(self.sizes[i] + 1) / np.maximum(n, 1)
        if not self.languages:
            return ["und"] * len(n), np.zeros(len(n))
        best = costs.argmin(axis=1)
        ranked = np.sort(costs, axis=1)
        score = 1 - ranked[:, 0] / np.maximum(ranked[:, 1], 1e-12) if len(self.languages) > 1 else np.ones(len(n))
        return [self.languages[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)], np.where(lettered, score, 0.0)


def fit_languages(labelled: DataFrame, docs: int = TRAIN_DOCS, chars: int = TRAIN_CHARS, key: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    """Automata from the beginnings of ``docs`` documents of each language, those with the smallest hash of the key.

    Rows without language, without key or without a letter teach nothing. What reaches the driver is bounded per language.
    """
    body = F.col(f"`{text}`")
    rows = labelled.where(F.col(f"`{lang}`").isNotNull() & F.col(f"`{key}`").isNotNull() & body.rlike("\\p{L}"))
    rows = rows.select(F.col(f"`{lang}`").alias("lang"), F.xxhash64(F.col(f"`{key}`").cast("string")).alias("mark"), F.substring(body, 1, chars).alias("text"))
    rows = rows.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy("mark", "text"))).where(F.col("place") <= docs)
    texts: dict[str, list[str]] = {}
    for row in rows.orderBy("lang", "place").select("lang", "text").toLocalIterator():
        texts.setdefault(row["lang"], []).append(row["text"])
    return LanguageModel.fit(texts)


def with_language(docs: DataFrame, model: LanguageModel, name: str = "language", text: str = "text") -> DataFrame:
    """The table with a struct (lang_pred, score) for every whole text.

    Each language's automaton cuts the text, letters lower-cased and other runs as one gap, into longest matches; their number times the bits of a
    place in that language's text, per letter, is the cost, and the lowest wins (ties: the first language in order). Null and empty
    texts and texts without a letter are ``und`` with score 0. Repeated rows score alike; extra columns pass through, one called ``name`` is replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            names, scores = [], []
            for chunk in text_chunks(texts):
                some, margin = held.value.predict(chunk)
                names += some
                scores.append(margin)
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1))], ["lang_pred", "score"])

    return docs.withColumn(name, predict(binary(text)))
