"""Quality classifier by co-training: one view sees the content of a text, the other its page metadata, and each labels examples for the other."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, binary, fresh_name, settle, text_chunks, whitespace_words, word_spans

#: Rows that the classifiers are fitted on, at most: labelled ones, and ones that only the views label. Those with the smallest hash of the key.
MAX_LABELLED, MAX_UNLABELLED = 8000, 8000
BYTE_BINS = 144  # ASCII one by one, the other bytes by eights
SOURCES, LANGS = 32, 16
CONTENT = BYTE_BINS + 6
METADATA = 8 + SOURCES + LANGS

_BIN = np.concatenate([np.arange(128), 128 + (np.arange(128, 256) - 128) // 8]).astype(np.int64)
_WORDS = whitespace_words()


def _per_text(index: np.ndarray, values: np.ndarray | None, n: int) -> np.ndarray:
    return np.bincount(index, values, n).astype(float)


def content_view(chunk: list[bytes], hasher: WordHasher) -> np.ndarray:
    """Square roots of byte shares, and how words repeat: n x CONTENT. Whole texts; nothing depends on where a word stands but its neighbour."""
    n = len(chunk)
    out = np.zeros((n, CONTENT))
    sizes = np.array([len(t) for t in chunk])
    owner = np.repeat(np.arange(n), sizes)
    raw = np.frombuffer(b"".join(chunk), np.uint8)
    counts = np.bincount(owner * BYTE_BINS + _BIN[raw], minlength=n * BYTE_BINS).reshape(n, BYTE_BINS)
    out[:, :BYTE_BINS] = np.sqrt(counts / np.maximum(sizes, 1)[:, None])
    buffer, starts, ends, text = word_spans(chunk, _WORDS)
    if len(starts):
        words = hasher.hashes(buffer, starts, ends)
        order = np.lexsort((words, text))
        w, t = words[order], text[order]
        first = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (t[1:] != t[:-1])]))
        times = np.diff(np.append(first, len(w)))
        words_of = _per_text(text, None, n)
        total = np.maximum(words_of, 1)
        top = np.zeros(n)
        np.maximum.at(top, t[first], times)
        same = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
        upper = (buffer[starts] >= 65) & (buffer[starts] <= 90)
        out[:, BYTE_BINS:] = np.stack(
            [
                np.log1p(words_of),
                _per_text(text, (ends - starts).astype(float), n) / total / 10,
                _per_text(t[first], None, n) / total,
                top / total,
                _per_text(text[1:][same], None, n) / total,
                _per_text(text, upper.astype(float), n) / total,
            ],
            axis=1,
        )
    return out


def _bucket(values: list, buckets: int) -> np.ndarray:
    """Stable bucket of each string from 1; null is bucket 0."""
    return np.array([0 if v is None else 1 + zlib.crc32(str(v).encode()) % (buckets - 1) for v in values], np.int64)


def metadata_view(chunk: list[bytes], langs: list, sources: list, n_chars: list) -> np.ndarray:
    """Stated length, layout of lines, language and source: n x METADATA. No content of a line is looked at."""
    n = len(chunk)
    out = np.zeros((n, METADATA))
    for i, raw in enumerate(chunk):
        lines = np.fromiter(map(len, raw.split(b"\n")), np.int64)
        stated = n_chars[i]
        out[i, :8] = [
            np.log1p(len(raw)),
            np.log1p(max(stated, 0)) if stated is not None else 0.0,
            float(stated is None),
            np.log1p(len(lines)),
            np.log1p(lines.mean()),
            lines.max() / max(len(raw), 1),
            (lines < 20).mean(),
            np.log1p(lines.std()),
        ]
    at = np.arange(n)
    out[at, 8 + _bucket(sources, SOURCES)] = 1
    out[at, 8 + SOURCES + _bucket(langs, LANGS)] = 1
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 15) -> np.ndarray:
    """Coefficients, the last one the intercept, of a ridge logistic regression by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = _sigmoid(x @ beta)
        curve = weight * np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * curve[:, None]).T @ x + np.diag(penalty), x.T @ (weight * (y - p)) - penalty * beta)
        beta += step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-4:
            break
    return beta


@dataclass
class View:
    """A standardised linear classifier and its calibration."""

    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray = field(default_factory=lambda: np.zeros(1))
    calibration: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0]))

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.standard(x) @ self.beta[:-1] + self.beta[-1]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.calibration[0] * self.margin(x) + self.calibration[1]


@dataclass
class QualityModel:
    """Both views, the weights that join their calibrated log odds, and what the fit saw. Without two classes: a constant score."""

    views: list[View]
    joint: np.ndarray
    constant: float | None
    facts: dict

    def score(self, content: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(content), self.constant)
        odds = np.stack([v.log_odds(x) for v, x in zip(self.views, (content, metadata), strict=True)], axis=1)
        return _sigmoid(odds @ self.joint[:-1] + self.joint[-1])


def co_train(content: np.ndarray, metadata: np.ndarray, y: np.ndarray, rounds: int = 4, sure: float = 0.95, share: float = 0.1) -> QualityModel:
    """Fit from rows with labels y in {0, 1} and rows without (y = -1).

    Every fourth labelled row is kept from the classifiers for calibration. In each round both views score the unlabelled rows; of those that a
    view is sure about, its surest ones, at most ``share`` of the rows of a class, get its label for the other view to learn from.
    """
    known = np.flatnonzero(y >= 0)
    facts = {"labelled": len(known), "unlabelled": int((y < 0).sum()), "pseudo": [0, 0]}
    base = (float((y[known] == 1).sum()) + 1) / (len(known) + 2)
    held = known[::4]
    fit = np.setdiff1d(known, held)
    if min((y[part] == c).sum() for part in (held, fit) for c in (0, 1)) == 0:
        return QualityModel([], np.zeros(3), base if len(known) else 1.0, facts)
    data = [content, metadata]
    views = [View(x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)) for x in data]
    z = [v.standard(x) for v, x in zip(views, data, strict=True)]
    free = np.flatnonzero(y < 0)
    given = [np.full(len(free), -1), np.full(len(free), -1)]  # labels that each view has been given

    def train(i: int) -> None:
        pseudo = given[i] >= 0
        rows = np.concatenate([fit, free[pseudo]])
        target = np.concatenate([y[fit], given[i][pseudo]]).astype(float)
        weight = np.concatenate([np.ones(len(fit)), np.full(int(pseudo.sum()), 0.5)])
        views[i].beta = logistic(z[i][rows], target, weight)

    for i in (0, 1):
        train(i)
    for _ in range(rounds if len(free) else 0):
        chances = [_sigmoid(views[i].margin(data[i][free])) for i in (0, 1)]
        for i in (0, 1):
            for label in (0, 1):
                p = chances[i] if label else 1 - chances[i]
                most = int(np.ceil(share * len(free) * (base if label else 1 - base)))
                new = np.flatnonzero((p >= sure) & (given[1 - i] < 0))
                given[1 - i][new[np.argsort(-p[new], kind="stable")][:most]] = label
        for i in (0, 1):
            train(i)
    facts["pseudo"] = [int((g >= 0).sum()) for g in given]
    odds, ones = [], np.ones(len(held))
    for i in (0, 1):
        views[i].calibration = logistic(views[i].margin(data[i][held])[:, None], y[held].astype(float), ones, 1e-3)
        odds.append(views[i].log_odds(data[i][held]))
    joint = logistic(np.stack(odds, axis=1), y[held].astype(float), ones, 1e-2)
    facts["held_out_accuracy"] = float(((np.stack(odds, axis=1) @ joint[:-1] + joint[-1] > 0) == (y[held] == 1)).mean())
    return QualityModel(views, joint, None, facts)


def views_of(texts: pa.Array, langs: pa.Array, sources: pa.Array, n_chars: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    hasher, at = WordHasher(), 0
    for chunk in text_chunks(texts):
        rows = slice(at, at + len(chunk))
        at += len(chunk)
        yield content_view(chunk, hasher), metadata_view(chunk, *(x[rows].to_pylist() for x in (langs, sources, n_chars)))


def fit_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_unlabelled: int = MAX_UNLABELLED, key: str = "doc_id", label: str = "quality", **options) -> QualityModel:
    """Fit on a bounded sample of ``docs`` (key, text, lang, source, n_chars) and ``labels`` (key, label 0 or 1).

    Labels that are null are left out; a key with several labels has their mean, from 1/2 on as 1. Of several documents with one key the
    largest text counts. Only keys are looked at to draw the sample, and only sampled texts to fit.
    """
    told = labels.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("key")).agg((F.avg(F.col(f"`{label}`")) >= 0.5).cast("int").alias("y"))
    told = told.orderBy(F.xxhash64(F.col("key").cast("string")), "key").limit(max_labelled)
    plain = docs.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("key"), F.lit(-1).alias("y"))
    plain = plain.orderBy(F.xxhash64(F.lit("pool"), F.col("key").cast("string")), "key").limit(max_unlabelled)
    ids = settle(told.unionByName(plain).groupBy("key").agg(F.max("y").alias("__y")).withColumnRenamed("key", "__key"), "sample")
    columns = [F.col(f"`{c}`").alias(c) for c in ("text", "lang", "source", "n_chars")]
    kept = docs.select(F.col(f"`{key}`").alias("__of"), *columns)
    rows = kept.join(F.broadcast(ids), F.col("__of") == F.col("__key")).drop("__of")
    one = rows.groupBy("__key", "__y").agg(F.max(F.struct("text", "lang", "source", "n_chars")).alias("d")).select("__key", "__y", "d.*")

    @F.arrow_udf("array<double>")
    def vector(texts: pa.Array, langs: pa.Array, sources: pa.Array, n_chars: pa.Array) -> pa.Array:
        parts = [np.hstack(pair) for pair in views_of(texts, langs, sources, n_chars)]
        return pa.array([row for part in parts for row in part], pa.list_(pa.float64()))

    got = one.select("__key", "__y", vector(binary("text"), "lang", "source", F.col("n_chars").cast("bigint")).alias("x")).toArrow()
    if not got.num_rows:
        return co_train(np.zeros((0, CONTENT)), np.zeros((0, METADATA)), np.zeros(0, int), **options)
    order = np.argsort(got.column("__key").to_numpy(), kind="stable")
    x = np.array(got.column("x").combine_chunks().flatten()).reshape(-1, CONTENT + METADATA)[order]
    return co_train(x[:, :CONTENT], x[:, CONTENT:], got.column("__y").to_numpy()[order], **options)


def with_quality(docs: DataFrame, model: QualityModel, name: str = "quality_score") -> DataFrame:
    """The table with a score from 0 to 1 for every whole text, by the joined calibrated views.

    Null and empty texts score 0. Null language, source or length are categories of their own. Repeated rows score alike. Extra columns
    pass through; an existing column called ``name`` is replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array, langs: pa.Array, sources: pa.Array, n_chars: pa.Array) -> pa.Array:
        parts = [held.value.score(*pair) for pair in views_of(texts, langs, sources, n_chars)]
        scores = np.concatenate(parts) if parts else np.zeros(0)
        return pa.array(np.where(np.array([bool(t.as_py()) for t in texts], bool), scores, 0.0))

    return docs.withColumn(name, score(binary("text"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("bigint")))


def keep_quality(docs: DataFrame, labels: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more under a model fitted on themselves and ``labels``; all columns kept."""
    name = fresh_name(docs, "quality_score")
    scored = with_quality(docs, fit_quality(docs, labels, **options), name)
    return scored.where(F.col(name) >= least).drop(name)
