"""License notices in texts by patience alignment with templates."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLD, binary, text_chunks

# Notices by which licenses are usually declared, each name with one wording.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
]

#: Words of all templates together that are broadcast.
MAX_WORDS = 5_000_000
#: Part of a template's neighbouring word pairs that a place must hold to be aligned.
LEAST_PAIRS = 0.2
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

MATCH = "struct<license:string,coverage:double,matched:bigint,start:bigint,end:bigint>"
RESULT = f"n_matches bigint, license string, coverage double, matches array<{MATCH}>"
_MATCH = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("matched", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
_RESULT = pa.struct([("n_matches", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("matches", pa.list_(_MATCH))])


def longest_rising(values: list[int]) -> list[int]:
    """Indexes of a longest strictly increasing subsequence, by patience piles with back pointers."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for i, value in enumerate(values):
        at = int(np.searchsorted(tops, value)) if len(tops) > 32 else sum(t < value for t in tops)
        back.append(piles[at - 1] if at else -1)
        if at == len(tops):
            tops.append(value)
            piles.append(i)
        else:
            tops[at], piles[at] = value, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(text: list, template: list) -> list[tuple[int, int]]:
    """Matched positions (in text, in template), both rising: anchors are words that occur once in either, of which the longest rising run
    stands; gaps between anchors are aligned in the same way; where no word is unique, equal words at both ends of the gap match."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and text[a0] == template[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and text[a1 - 1] == template[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        places: dict = {}
        for i in range(a0, a1):
            places[text[i]] = -1 if text[i] in places else i
        seen: dict = {}
        for j in range(b0, b1):
            seen[template[j]] = -1 if template[j] in seen else j
        pairs = [(places[w], j) for w, j in seen.items() if j >= 0 and places.get(w, -1) >= 0]
        anchors = [pairs[k] for k in longest_rising([p[0] for p in pairs])]
        if not anchors:
            continue
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


@dataclass
class Template:
    name: str
    words: list[int]
    pairs: np.ndarray  # codes of neighbouring words, in order of code
    places: np.ndarray  # where each pair stands first
    once: np.ndarray  # whether it stands there only


class LicenseScanner:
    def __init__(self, templates: list[tuple[str, bytes]], least: float) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.templates, self.least = [], least
        found = []
        for name, raw in templates:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in raw.translate(FOLD).split()]
            if len(words) > 1:
                found.append((name, words))
        self.base = len(self.vocabulary) + 1
        for name, words in found:
            ids = np.array(words, np.int64)
            pairs, places, counts = np.unique(ids[:-1] * self.base + ids[1:], return_index=True, return_counts=True)
            self.templates.append(Template(name, words, pairs, places, counts == 1))

    def regions(self, t: Template, codes: np.ndarray, owner: np.ndarray) -> list[tuple[int, int, int]]:
        """Texts and word ranges that may hold the template: runs of its pairs in rising template order, close together and of one text, widened by what
        the template has before and after them. Pairs that the template repeats cut such runs, so where it has any, ``diagonals`` are added."""
        at = np.flatnonzero(np.isin(codes, t.pairs))
        if not len(at):
            return []
        place = t.places[np.searchsorted(t.pairs, codes[at])]
        reach = len(t.words)
        cut = np.flatnonzero((np.diff(at) > reach) | (np.diff(place) < 0) | (np.diff(owner[at]) != 0)) + 1
        out = []
        for part in np.split(np.arange(len(at)), cut):
            if len(part) >= max(1, LEAST_PAIRS * len(t.pairs)):
                low, high = int(at[part[0]] - place[part[0]]), int(at[part[-1]] + reach - place[part[-1]])
                out.append((int(owner[at[part[0]]]), low - 2, high + 2))
        return out if t.once.all() else list(dict.fromkeys(out + self.diagonals(t, codes, at, owner)))

    def diagonals(self, t: Template, codes: np.ndarray, at: np.ndarray, owner: np.ndarray) -> list[tuple[int, int, int]]:
        """As ``regions``, from pairs that the template has once: those of one copy begin the template at about the same word of the text, whatever is
        repeated between them. Starts are counted in bins of an eighth of the template, and neighbouring full bins are one place."""
        at = at[np.isin(codes[at], t.pairs[t.once])]
        place = t.places[np.searchsorted(t.pairs, codes[at])]
        reach, least = len(t.words), max(1, LEAST_PAIRS * t.once.sum())
        # Texts lie end to end; starts before their text stay nearer to it than a template's length.
        bins = (at - place + reach) // max(1, reach // 8) + owner[at] * (2 * reach // max(1, reach // 8) + 2)
        order = np.argsort(bins, kind="stable")
        at, place = at[order], place[order]
        values, first, counts = np.unique(bins[order], return_index=True, return_counts=True)
        beside = np.where(np.diff(values, append=-1) == 1, np.append(counts[1:], 0), 0)
        before = np.where(np.diff(values, prepend=-2) == 1, np.append(0, counts[:-1]), 0)
        full = np.flatnonzero(np.maximum(beside, before) + counts >= least)
        out = []
        for run in np.split(full, np.flatnonzero(np.diff(values[full]) > 1) + 1) if len(full) else []:
            own = slice(first[run[0]], first[run[-1]] + counts[run[-1]])
            low, high = int((at[own] - place[own]).min()), int((at[own] - place[own]).max()) + reach
            out.append((int(owner[at[own][0]]), low - 2, high + 2))
        return out

    def scan(self, chunk: list[bytes]) -> list[dict]:
        get = self.vocabulary.get
        ids: list[int] = []
        ends = []
        for raw in chunk:
            ids += [get(w, 0) for w in raw.translate(FOLD).split()]
            ends.append(len(ids))
            ids.append(0)
        array, ends = np.array(ids, np.int64), np.array(ends)
        starts = np.concatenate([[0], ends[:-1] + 1])
        codes = np.where((array[:-1] > 0) & (array[1:] > 0), array[:-1] * self.base + array[1:], -1)
        owner = np.repeat(np.arange(len(chunk)), ends - starts + 1)
        matches: dict[int, list[tuple]] = {}
        for t in self.templates:
            for text, low, high in self.regions(t, codes, owner):
                low, high = max(low, int(starts[text])), min(high, int(ends[text]))
                pairs = align(ids[low:high], t.words)
                coverage = len(pairs) / len(t.words)
                if coverage >= self.least:
                    matches.setdefault(text, []).append((low + pairs[0][0] - int(starts[text]), low + pairs[-1][0] - int(starts[text]), coverage, len(pairs), t.name))
        return [self.result(raw, matches.get(i, [])) for i, raw in enumerate(chunk)]

    @staticmethod
    def result(raw: bytes, found: list[tuple]) -> dict:
        """Of matches that overlap, the one with most words stays (then coverage, name, place)."""
        kept: list[tuple] = []
        for m in sorted(found, key=lambda m: (-m[3], -m[2], m[4], m[0])):
            if all(m[1] < k[0] or m[0] > k[1] for k in kept):
                kept.append(m)
        spans = [w.span() for w in _WORD.finditer(raw.lower())] if kept else []
        rows = [{"license": m[4], "coverage": m[2], "matched": m[3], "start": spans[m[0]][0], "end": spans[m[1]][1]} for m in sorted(kept)]
        best = min(rows, key=lambda r: (-r["coverage"], -r["matched"], r["license"]), default={"license": None, "coverage": 0.0})
        return {"n_matches": len(rows), "license": best["license"], "coverage": best["coverage"], "matches": rows}


def scan_licenses(docs: DataFrame, templates: DataFrame | None = None, least: float = 0.8, text: str = "text", name: str = "license_scan") -> DataFrame:
    """The table with a struct column: every place of a whole text that covers ``least`` of a template's words, and the best of them.

    ``templates`` has (name, text); ``NOTICES`` if not given. Words are compared with A-Z lower-cased, whatever stands between them. A place is found by
    neighbouring word pairs of the template in rising order, or of those it has once by the start they imply, at least a fifth, then aligned;
    repeated notices are places of their own. start and end are bytes of the UTF-8 text. Templates go to every task after a check of their size, so documents are neither
    shuffled nor joined.

    Null or empty text: no match, license null, coverage 0. Templates that are null or have fewer than two words match nothing. Ties go to the
    name first in order. Repeated rows scan alike; extra columns pass through, one called ``name`` is replaced.
    """
    if templates is None:
        rows = [(n, t.encode()) for n, t in NOTICES]
    else:
        body = F.coalesce("text", F.lit(""))
        size = templates.agg(F.sum(F.octet_length(body))).first()[0] or 0
        if size > 8 * MAX_WORDS:
            raise ValueError(f"templates of {size} bytes are too large to send to every task")
        rows = [(r[0] or "", bytes(r[1])) for r in templates.select("name", body.cast("binary")).collect()]
    scanner = docs.sparkSession.sparkContext.broadcast(LicenseScanner(rows, least))

    @F.arrow_udf(RESULT)
    def scan(texts: pa.Array) -> pa.Array:
        out = []
        for chunk in text_chunks(texts):
            out += scanner.value.scan(chunk)
        return pa.array(out, _RESULT)

    return docs.withColumn(name, scan(binary(text)))
