"""Operators that SQL cannot state, against plain versions of their results."""

import math
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from facetry.llm import language_id, license_scan, line_dedup, lm_scoring, mixing, near_dedup, quality, sharding, vector_search
from facetry.llm.common import components, mix64, text_chunks
from facetry.llm.queries import QUERIES

from .helpers import words

SF = "/root/testdata/sf0.001"


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(left[j] + 1, row[-1] + 1, left[j - 1] + (x != y)))
    return row[-1]


def edited(rng, text, edits, alphabet="abcdé"):
    chars = list(text)
    for _ in range(edits):
        at = rng.randrange(len(chars) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            chars.insert(at, rng.choice(alphabet))
        elif chars:
            at = min(at, len(chars) - 1)
            chars[at : at + 1] = [] if kind == 1 else [rng.choice(alphabet)]
    return "".join(chars)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance(edits):
    rng = random.Random(edits)
    pairs = []
    for _ in range(800):
        a = "".join(rng.choice("abcé") for _ in range(rng.randrange(70)))
        pairs.append((a, edited(rng, a, rng.randrange(6))))
    assert line_dedup.banded_distance(pairs, edits).tolist() == [min(plain_distance(a, b), edits + 1) for a, b in pairs]


def lines_table(spark, seed, hot):
    """Lines with planted edits; with ``hot``, several hundred variants of one line in which two characters of one place run through a range."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(18, 50))) for _ in range(60)]
    lines = base + [edited(rng, rng.choice(base), rng.randrange(5)) for _ in range(150)] + base[:10]
    lines += [f"page {i:03d} of the same long book of pages" for i in range(hot)]
    rng.shuffle(lines)
    texts = ["\n".join(lines[i : i + 4]) for i in range(0, len(lines), 4)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), texts


@pytest.mark.parametrize("hot", [0, 300])
def test_line_classes(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "PART_ROWS", 100)
    docs, texts = lines_table(spark, 5, hot)
    places = [(d, n, x.strip()) for d, t in enumerate(texts) for n, x in enumerate(t.split("\n")) if x.strip()]
    distinct = sorted({p[2] for p in places})
    at = {x: i for i, x in enumerate(distinct)}
    links = []
    for i, a in enumerate(distinct):
        near = [j for j in range(i) if min(len(a), len(distinct[j])) >= 20 and abs(len(a) - len(distinct[j])) <= 2]
        got = line_dedup.banded_distance([(a, distinct[j]) for j in near], 2)
        links += [(i, j) for j, d in zip(near, got, strict=True) if d <= 2]
    root = roots(len(distinct), links)
    first = {}
    for d, n, x in places:
        first[root[at[x]]] = min(first.get(root[at[x]], (d, n)), (d, n))
    expected = {(d, n): first[root[at[x]]] for d, n, x in places}
    got = {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no) for r in line_dedup.line_classes(docs).collect()}
    assert got == expected
    assert len(set(expected.values())) < len(distinct)


@pytest.mark.parametrize("with_keys", [True, False])
def test_rows_do_not_depend_on_chunks(monkeypatch, with_keys):
    rng = random.Random(9)
    texts = ["\n".join(words(rng, 8) for _ in range(5)) for _ in range(12)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(14)), pa.array([t and t.encode() for t in texts], pa.binary())], names=["key", "text"])

    def rows(limit):
        monkeypatch.setattr(line_dedup, "text_chunks", lambda column: text_chunks(column, limit))
        return sorted(str(r) for b in line_dedup._emit(line_dedup.LineKeys(), with_keys)(iter([batch])) for r in b.to_pylist())

    assert len(rows(1)) == 60 and rows(1) == rows(1 << 20)


def test_forest_of_false_candidates(spark):
    """Anagrams share sketches but are far apart: a dense group whose forest fails gives all its pairs instead."""
    rng = random.Random(2)
    tails = ["".join(rng.sample("abcdefghijkl", 12)) for _ in range(40)]
    tails += [edited(rng, t, 1, "abcdefghijkl") for t in tails[:10]]
    docs = spark.createDataFrame([(i, "the same head of a line " + t) for i, t in enumerate(tails)], "doc_id bigint, text string")
    links = [(i, j) for i in range(len(tails)) for j in range(i) if plain_distance(tails[i], tails[j]) <= 2]
    got = {r.doc_id: r.class_doc_id for r in line_dedup.line_classes(docs).collect()}
    assert [got[i] for i in range(len(tails))] == roots(len(tails), links)


def test_dedup_lines(spark):
    docs = spark.createDataFrame([(1, "first line that is long enough\nshort\n\nother"), (2, "short\nfirst line that is long enuogh\nown")], "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {1: "first line that is long enough\nshort\n\nother", 2: "own"}


def test_components(spark):
    rng = random.Random(4)
    n = 400
    links = [(i, i + 1) for i in range(100)] + [(150, j) for j in range(151, 220)] + [(rng.randrange(230, n), rng.randrange(230, n)) for _ in range(90)]
    rng.shuffle(links)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    root = roots(n, links)
    assert got == {i: root[i] for a, b in links if a != b for i in (a, b)}


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    prints = [plain_fingerprint(d.text) for d in docs]
    links = [(i, j) for i in range(len(docs)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    root = roots(len(docs), links)
    low = {}
    for i, d in enumerate(docs):
        low[root[i]] = min(low.get(root[i], d.doc_id), d.doc_id)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op9_near_duplicates"](spark, SF).collect()}
    assert got == {d.doc_id: (f"{p:016x}", low[root[i]]) for i, (d, p) in enumerate(zip(docs, prints, strict=True))}
    jvm = spark.createDataFrame([("a b c d",)], "t string").select(F.xxhash64("t")).first()[0]
    assert jvm & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b c d", 42)


@pytest.mark.parametrize("part_rows", [4096, 30])
def test_links_at_every_distance(spark, monkeypatch, part_rows):
    """Planted fingerprints at distances up to 4 are all linked, in hot anchors too; farther ones are not."""
    monkeypatch.setattr(near_dedup, "PART_ROWS", part_rows)
    rng = random.Random(1)
    fps = []
    for _ in range(60):
        base = rng.getrandbits(64)
        fps.append(base)
        for distance in (1, 2, 3, 4, 5, 7):
            other = base
            for bit in rng.sample(range(64), distance):
                other ^= 1 << bit
            fps.append(other)
    hub = rng.getrandbits(64)
    fps += [hub ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(i)]
    fps = sorted(set(fps))
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    links = near_dedup.linked_fingerprints(spark.createDataFrame([(s,) for s in signed], "fp bigint")).collect()
    place = {s: i for i, s in enumerate(signed)}
    got = roots(len(fps), [(place[r.a], place[r.b]) for r in links])
    assert got == roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])


def test_covering_code():
    anchor, near = near_dedup._code()
    assert len(set(anchor.tolist())) == 2**11
    assert max(int(w ^ a).bit_count() for w, a in enumerate(anchor.tolist())) == 1
    for w in (0, 1, 5, 0x7FFF, 12345):
        assert set(near[w].tolist()) == {int(anchor[w])} | {int(anchor[w ^ (1 << i)]) for i in range(15)}


def test_drop_near_duplicates_keeps_one(spark):
    text = "one two three four five six seven eight"
    docs = spark.createDataFrame([(3, text), (1, text), (2, "quite another text of words"), (None, text)], "doc_id bigint, text string")
    assert sorted(str(r.doc_id) for r in near_dedup.drop_near_duplicates(docs).collect()) == ["1", "2", "None"]


def five_word_sets(texts):
    split = [(t or "").encode().lower().split() for t in texts]
    return [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in split]


def test_similar_documents_link_all_near_copies(spark):
    """Edited copies at five-word similarity 0.8 or more are found, far beyond 4 bits, in a large group too; less similar ones are not linked."""
    rng = random.Random(5)
    texts = ["", None, " \n", "short text", "Short  TEXT", "short texts"]
    for edits in (1, 3, 5, 8, 12, 20):
        base = [f"v{rng.randrange(3000)}" for _ in range(300)]
        for _ in range(12):
            copy = list(base)
            for at in rng.sample(range(300), edits):
                copy[at] = f"x{rng.randrange(3000)}"
            texts.append(" ".join(copy))
    sets = five_word_sets(texts)
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = roots(len(texts), links)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.similar_documents(docs).collect()} == dict(enumerate(root))
    kept = sorted(r.doc_id for r in near_dedup.drop_near_duplicates(docs, similarity=0.8).collect())
    assert kept == [i for i, r in enumerate(root) if r == i] and len(kept) < near_dedup.drop_near_duplicates(docs).count()


def test_language_on_held_out_rows(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in QUERIES["op4_language"](spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got) and len(got) > 200
    assert sum(truth[r.doc_id] == r.lang_pred for r in got) / len(got) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_cross_parse_counts_longest_matches():
    model = language_id.LanguageModel.fit({"x": ["abcab cab"], "y": ["zzz yyy"]})
    table = model.tables[model.languages.index("x")]
    known = model.encode(["abcab cab"])[0].tolist()
    subs = {tuple(known[i:j]) for i in range(len(known)) for j in range(i + 1, len(known) + 1)}
    for text in ("abc", "cabab", "qab", "abqqcab bca", "zzz"):
        line = model.encode([text])[0]
        count, at = 0, 0
        while at < len(line):
            end = at + 1
            while end < len(line) and tuple(line[at : end + 1].tolist()) in subs and tuple(line[at:end].tolist()) in subs:
                end += 1
            count, at = count + 1, end
        assert model.phrases(line, np.array([0]), np.array([len(line)]), table)[0] == count


def test_alignment():
    text = "x please note licensed under the big apache license version two y".split()
    template = "licensed under the apache license version 2 now".split()
    pairs = license_scan.align(text, template)
    assert [template[j] for _, j in pairs] == ["licensed", "under", "the", "apache", "license", "version"]
    assert all(text[i] == template[j] for i, j in pairs)
    rng = random.Random(6)
    for _ in range(300):
        values = [rng.randrange(12) for _ in range(rng.randrange(12))]
        best = max((len(s) for m in range(1 << len(values)) if (s := [v for i, v in enumerate(values) if m >> i & 1]) is not None and all(p < q for p, q in zip(s, s[1:]))), default=0) if len(values) < 9 else None
        got = license_scan.longest_rising(values)
        assert all(values[p] < values[q] for p, q in zip(got, got[1:]))
        assert best is None or len(got) == best


def test_license_places(spark):
    notices = dict.fromkeys(n for n, _ in license_scan.NOTICES[:4])
    text = "é start.\nLicensed under the Apache License, Version 2.0.\nbody of the work\nReleased under the MIT License.\nReleased under THE mit license"
    docs = spark.createDataFrame([(1, text), (2, "the license of the version is under the sun"), (3, "This work has been licensed under GNU General Public License version 3")], "doc_id bigint, text string")
    got = {r.doc_id: r.license_scan for r in license_scan.scan_licenses(docs).collect()}
    raw = text.encode()
    assert [raw[m.start : m.end].decode() for m in got[1].matches] == ["Licensed under the Apache License, Version 2.0", "Released under the MIT License", "Released under THE mit license"]
    assert got[1].n_matches == 3 and got[1].license == "Apache-2.0" and got[2].n_matches == 0 and got[2].license is None
    assert got[3].license == "GPL-3.0" and 0.8 <= got[3].coverage < 1 and "GPL-3.0" in notices


def test_licenses_of_the_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    for r in QUERIES["op3_license_scan"](spark, "/root/testdata/sf0.01").collect():
        assert r.n_matches == sum(texts[r.doc_id].count(t) for _, t in license_scan.NOTICES[:4])


@pytest.mark.parametrize("name", ["Apache-2.0", "GPL-3", "MPL-2.0"])
def test_long_license_texts(name):
    """Whole licences, which repeat many word pairs, are found word for word, twice in a row, and lightly edited."""
    rng = random.Random(2)
    text = Path(f"/usr/share/common-licenses/{name}").read_bytes()
    edited = [w for w in text.split() if rng.random() > 0.03]
    scanner = license_scan.LicenseScanner([(name, text)], 0.8)
    chunk = [words(rng, 500).encode() + b" " + text, text + b"\n" + text, b" ".join(edited), words(rng, 5000).encode()]
    got = scanner.scan(chunk)
    assert [r["n_matches"] for r in got] == [1, 2, 1, 0]
    assert got[0]["coverage"] == 1 and [m["coverage"] > 0.99 for m in got[1]["matches"]] == [True, True] and got[2]["coverage"] > 0.9


def test_lm_scores_of_a_table_united_with_itself(spark):
    """Equal chunks keep all their rows and score like rows of one chunk."""
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, words(rng, 30)) for i in range(20)], "doc_id bigint, text string")
    docs = docs.unionByName(docs)
    score = lambda d: sorted(tuple(r) for r in lm_scoring.score_texts(d, F.col("doc_id") % 5 == 0).collect())
    apart, together = score(docs), score(docs.coalesce(1))
    assert len(apart) == len(together) == 40
    for a, b in zip(apart, together, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:])


def test_lm_contract(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    tokens = {d.doc_id: [*(d.text or "").encode().lower().split(), None] for d in docs}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    counts = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(counts.values()), len(counts)
    rows = QUERIES["op6_lm_scores"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        t = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(counts[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel=1e-9)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_lm_probabilities_sum_to_one(spark):
    rng = random.Random(8)
    train = spark.createDataFrame([(i, words(rng, 60, 80)) for i in range(60)], "doc_id bigint, text string")
    model = lm_scoring.PitmanYorModel(train, lm_scoring.Settings())
    states = [lm_scoring.Seating(r.bucket, bytes(r.data), model.settings, model.corpus) for r in model.counts.collect()]
    share = lm_scoring.backoff(model.corpus, model.settings, model.sweeps)
    total = np.zeros(lm_scoring.CONTEXTS)
    for s in states:
        own, parent = s.model(model.sweeps)
        total += np.bincount(s.contexts, own, lm_scoring.CONTEXTS) + share @ parent.sum(axis=0) / len(model.sweeps)
        assert ((s.tables >= 1) & (s.tables <= s.counts)).all() and ((s.top >= 1) & (s.top <= s.guests)).all()
    unseen = np.array([lm_scoring._unseen(model.corpus, model.settings, i) for i in model.sweeps])
    assert np.allclose(total + share @ unseen / len(model.sweeps), 1)
    # Every word scored by itself, after one context, gives the model's own numbers.
    probe = spark.createDataFrame([(1002, "unknown w1"), (1003, "")], "doc_id bigint, text string")
    scored = {r.doc_id: r for r in lm_scoring.score_texts(train.unionByName(probe), F.col("doc_id") == 999).collect()}
    assert scored[1002].n_known == 3 and scored[1003].n_tokens == 1


def test_lm_seats_kept_and_settled(spark):
    """Seats kept from sweep to sweep give the model that the counts alone give, and the query's own sweeps start their samples where tables have settled."""
    rng = random.Random(9)
    train = spark.createDataFrame([(i, words(rng, 80, 300)) for i in range(150)], "doc_id bigint, text string")
    model = lm_scoring.PitmanYorModel(train, lm_scoring.Settings())
    assert model.seated.count() == model.counts.count() > 0
    for r in model.seated.collect():
        plain = lm_scoring.Seating(r.bucket, bytes(r.data), model.settings, model.corpus)
        kept = lm_scoring.Seating(r.bucket, bytes(r.data), model.settings, model.corpus).sit(bytes(r.seats))
        for one, two in zip(kept.averaged(model.sweeps), plain.model(model.sweeps), strict=True):
            assert np.allclose(one, two)
        assert (kept.guests == plain.guests).all() and (kept.top == plain.top).all()
    long = lm_scoring.PitmanYorModel(train, lm_scoring.Settings(seed=12), 20, 10)
    far = np.mean([long.corpus.sweeps[i].guests for i in long.sweeps])
    assert len(model.sweeps) >= 5
    assert abs(np.mean([model.corpus.sweeps[i].guests for i in model.sweeps]) - far) < 0.005 * far


def test_lm_every_word_is_a_context_of_its_own(spark):
    """Nothing is known of a word from what follows others, as where their hashes agree in some bits."""
    tokens, places = lm_scoring.Tokens(), {}
    for i in range(2_000):
        places.setdefault(int(mix64(tokens.read([b"k%d" % i])[0][:1])[0]) % 16_384, []).append(i)
    pairs = [p[:2] for p in places.values() if len(p) > 1]
    assert len(pairs) > 50
    rows = [(i, f"k{i} v{i} k{i} v{i} k{i} v{i} k{i}") for i in sum(pairs, [])]
    probes = [(10_000 + i, f"k{i} v{i}") for i, _ in pairs] + [(20_000 + i, f"k{i} v{j}") for i, j in pairs]
    docs = spark.createDataFrame(rows + probes, "doc_id bigint, text string")
    score = {r.doc_id: r.score for r in lm_scoring.score_texts(docs, F.col("doc_id") >= 10_000).collect()}
    # Three of the four customers of k{i} sit at v{i}, and none at v{j}.
    assert all(score[10_000 + i] - score[20_000 + i] > 1 for i, _ in pairs)


def test_lm_contexts_in_buckets(spark):
    """Contexts and words that are not held by all tasks: counts, tables, probabilities that sum to one and scores against plain ones from the seats."""
    rng = random.Random(21)
    texts = [words(rng, rng.randrange(60), 5) if i % 9 == 0 else words(rng, 40, rng.choice((60, 400))) for i in range(120)]
    texts += texts[:3] + ["", " Z\tz\n"]
    train = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    settings = lm_scoring.Settings(shared=20, split=6)
    model = lm_scoring.PitmanYorModel(train, settings)
    corpus, frequent, n = model.corpus, model.frequent, len(model.sweeps)
    assert len(frequent.contexts) == 20 and len(frequent.words) == 6
    counts, tables, excess, guests, home = {}, {}, {}, {}, Counter()
    for r in model.seated.collect():
        state = lm_scoring.Seating(r.bucket, bytes(r.data), settings, corpus).sit(bytes(r.seats))
        names = [*state.words.tolist(), *frequent.words.tolist()]
        for o, u, c, t in zip(state.owner.tolist(), state.context_ids.tolist(), state.counts.tolist(), state.sampled.tolist(), strict=True):
            pair = (u if u >= lm_scoring.LEAST else int(frequent.contexts[u]), names[o])
            assert pair not in counts and n <= t <= n * c
            counts[pair], tables[pair] = c, t
            home[(o >= len(state.words), u >= lm_scoring.LEAST)] += 1
        guests |= {w: [g[i] for g in state.samples] for i, w in enumerate(state.words.tolist())}
        keys, *over = lm_scoring._unpack(bytes(r.shares)) or [[]]
        excess |= {int(u): [int(e[i]) for e in over] for i, u in enumerate(keys)}
    assert min(home[k] for k in ((False, False), (False, True), (True, False), (True, True))) > 50 and len(excess) > 20
    guests |= {w: [x for i in model.sweeps for x in (corpus.sweeps[i].hot_guests[j], corpus.sweeps[i].hot_top[j])] for j, w in enumerate(frequent.words.tolist())}
    tokens = lm_scoring.Tokens()
    read = lambda t: [x.tolist() for x in tokens.read([t.encode()])[:2]]
    assert Counter((u, w) for t in texts for w, u in zip(*read(t), strict=True)) == counts
    customers, held = Counter(), Counter()
    for (u, w), c in counts.items():
        customers[u] += c
        held[u] += tables[u, w]
    of = {u: [corpus.sweeps[i].tables[j] for i in model.sweeps] for j, u in enumerate(frequent.contexts.tolist()) if customers[u]}
    of |= {u: [customers[u] - e for e in excess.get(u, [0] * n)] for u in customers if u not in of}
    assert all(sum(of[u]) == held[u] for u in customers)

    def p(w, u):
        own = (counts.get((u, w), 0) - settings.discount * tables.get((u, w), 0) / n) / (settings.concentration + customers[u])
        for j, i in enumerate(model.sweeps):
            t, (g, top) = corpus.sweeps[i], guests.get(w, [0] * 2 * n)[2 * j : 2 * j + 2]
            parent = g - settings.word_discount * top + (settings.word_concentration + settings.word_discount * t.top) / (corpus.words + 1)
            share = (settings.concentration + settings.discount * of.get(u, [0] * n)[j]) / (settings.concentration + customers[u])
            own += share * parent / (settings.word_concentration + t.guests) / n
        return own

    vocabulary = sorted({w for _, w in counts})
    for u in [*sorted(customers)[::7], *frequent.contexts.tolist(), 99]:
        assert sum(p(w, u) for w in [*vocabulary, 99]) == pytest.approx(1)
    probes = [words(rng, 12, 500) for _ in range(60)] + ["unknown w1 unknown w399 z w2", "z z z"]
    docs = train.unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(probes)], "doc_id bigint, text string"))
    plain = {i: sum(math.log10(p(w, u)) for w, u in zip(*read(t), strict=True)) for i, t in [*enumerate(texts), *enumerate(probes, 1000)]}
    score = lambda **k: {r.doc_id: r.score for r in lm_scoring.score_texts(docs, F.col("doc_id") >= 1000, lm_scoring.Settings(**k)).collect()}
    got, shared = score(shared=20, split=6), score()
    assert got == pytest.approx(plain, rel=1e-6)
    # Where restaurants are held is not part of the model: only the draws differ.
    for some in ([i for i in plain if i < 1000], [i for i in plain if i >= 1000]):
        assert sum(got[i] for i in some) == pytest.approx(sum(shared[i] for i in some), rel=0.005)


def test_lm_reads_a_batch_in_chunks(monkeypatch):
    """Each chunk of a batch is a part with its own rows, tokens, and contexts to ask for."""
    monkeypatch.setattr(lm_scoring, "CHUNK", 300)
    rng = random.Random(22)
    texts = [words(rng, 30) for _ in range(40)]
    names = np.unique(lm_scoring.Tokens().read([t.encode() for t in texts])[0])
    frequent = lm_scoring.Frequent(np.sort(np.append(names[:10], np.uint64(lm_scoring.START))), names[:3])
    corpus = lm_scoring.Corpus(1, 1, np.zeros(11))
    batch = pa.RecordBatch.from_pydict({"key": list(range(40)), "held_out": [False] * 40, "text": [t.encode() for t in texts]})
    value = type("Value", (), {"__init__": lambda self, v: setattr(self, "value", v)})
    run = lm_scoring._read(lm_scoring.Settings(shared=11), value(corpus), value(frequent), value((names[:0], np.zeros(0), np.zeros((0, 11)))))
    parts = [r.to_pylist() for r in run(iter([batch]))]
    assert len(parts) > 10 and all({r["kind"] for r in part} == {1, 2, 3} for part in parts)
    keys = []
    for part in parts:
        (head,) = (r["data"] for r in part if r["kind"] == 2)
        size = int.from_bytes(head[:8], "little")
        keys += pa.ipc.open_stream(head[8 : 8 + size]).read_next_batch().column("key").to_pylist()
        sent = [lm_scoring._unpack_pairs(r["data"]) for r in part if r["kind"] == 1]
        assert sum(len(s[2]) for s in sent) == lm_scoring._unpack(head[8 + size :])[0].sum()
    assert keys == list(range(40))


def test_gibbs_tables_follow_the_conditional():
    """Tables of a dish with 5 customers against their exact distribution S(5, t) w^t."""
    d, w, c = 0.5, 0.7, 5
    s = np.zeros((c + 1, c + 2))
    s[1, 1] = 1
    for i in range(1, c):
        for t in range(1, i + 2):
            s[i + 1, t] = s[i, t - 1] + (i - t * d) * s[i, t]
    exact = s[c, 1 : c + 1] * w ** np.arange(1, c + 1)
    exact /= exact.sum()
    rng = np.random.default_rng(1)
    t = np.ones(40_000)
    for _ in range(12):
        t = lm_scoring.gibbs_tables(t, np.full(len(t), c), np.full(len(t), w), d, rng)
    assert np.abs(np.bincount(t.astype(int), minlength=c + 1)[1:] / len(t) - exact).max() < 0.01


@pytest.mark.parametrize("discount", [0.5, 0.8])
def test_tables_of_many_customers(discount):
    """Mean and spread of the draws against the exact distribution of S(c, t) w^t, from few tables to nearly one a customer."""
    top, rng = 1200, np.random.default_rng(5)
    logs, t = np.full(top + 1, -np.inf), np.arange(1, top + 1)
    logs[1] = 0
    for c in range(1, 10_001):
        if c in (10, 100, 300, 1_000, 10_000):
            for w in (0.05, 0.5, 5, 20, 100, 500, 5_000):
                log_p = logs[1 : c + 1] + np.log(w) * t[:c]
                p = np.exp(log_p - log_p.max())
                p /= p.sum()
                if len(p) == top and p[-1] > 1e-9:
                    continue
                n, mean = 3_000, (p * t[:c]).sum()
                spread = np.sqrt((p * (t[:c] - mean) ** 2).sum())
                got = lm_scoring.gibbs_tables(None, np.full(n, c), np.full(n, float(w)), discount, rng)
                assert got.min() >= 1 and got.max() <= c
                assert abs(got.mean() - mean) < max(0.02 * mean, 5 * spread / np.sqrt(n)) and abs(got.std() - spread) < 0.1 * spread + 0.02
        with np.errstate(divide="ignore"):
            logs[1:] = np.logaddexp(logs[:-1], np.log(np.maximum(c - t * discount, 0)) + logs[1:])


@pytest.mark.parametrize("shard_rows", [16, 100, 10_000])
def test_top_k(spark, shard_rows):
    rng = np.random.default_rng(2)
    x = rng.integers(-3, 4, (300, 5))
    rows = [(i, [int(v) for v in r]) for i, r in enumerate(x)] + [(1000, [1, 2, 3])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, v array<bigint>")
    got = vector_search.top_inner_products(vectors, F.col("vec_id") % 25 == 0, 10, shard_rows=shard_rows, block_queries=5).collect()
    found = {q: [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in {r.query_id for r in got}}
    for q in range(0, 300, 25):
        scores = sorted(((-int(x[q] @ x[i]), i) for i in range(300) if i != q))[:10]
        assert found[q] == [(i, -s) for s, i in scores]
    assert 1000 not in found


def test_top_k_refuses_overflow(spark):
    vectors = spark.createDataFrame([(0, [2**40]), (1, [2**40])], "vec_id bigint, v array<bigint>")
    with pytest.raises(Exception, match="64 bits"):
        vector_search.top_inner_products(vectors, F.col("vec_id") == 0).collect()


def test_quality_separates(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    half = F.xxhash64(F.col("doc_id")) % 2 == 0
    model = quality.fit_quality(docs, labels.where(half))
    assert min(model.facts["pseudo"]) > 0 and model.facts["held_out_accuracy"] > 0.9
    rows = quality.with_quality(docs, model).join(labels.where(~half), "doc_id").select("quality", "quality_score").collect()
    assert sum((r.quality_score >= 0.5) == (r.quality == 1) for r in rows) / len(rows) > 0.95


def test_quality_without_two_classes(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3), (2, None, None, None, None)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    got = {r.doc_id: r.quality_score for r in quality.with_quality(docs, quality.fit_quality(docs, none)).collect()}
    assert got == {1: 1.0, 2: 0.0}


def test_targets_and_words_taken(spark):
    rows = mixing.mix_sources(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).collect()
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        target, size, taken = by.get(r.source, (r.target, r.source_size, 0))
        by[r.source] = (target, size, taken + r.taken)
    assert all(taken == round(target) and target <= 2 * size for target, size, taken in by.values())
    assert sum(t for t, _, _ in by.values()) == pytest.approx(1.5 * sum(s for _, s, _ in by.values()))


def test_better_documents_come_first(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.lit("s").alias("source"))
    mix = mixing.mix_sources(docs, share=0.5, quality=F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0))
    got = mix.groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.sum("taken").alias("n")).collect()
    taken = {r.odd: r.n for r in got}
    assert taken[0] + taken[1] == 8000 and taken[0] > 2 * taken[1]


def test_buckets_give_the_order_of_one_sort(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    one = mixing.mix_sources(docs).orderBy("doc_id").collect()
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    assert mixing.mix_sources(docs).orderBy("doc_id").collect() == one


def test_shards(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = sharding.shard_documents(docs, 24).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    loads, slots = Counter(), {}
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
        loads[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(24))
    assert max(loads.values()) - min(loads.values()) < 0.02 * sum(loads.values()) / 24


def test_map_versions(spark, tmp_path):
    records = spark.range(20_000).select(sharding.virtual_slot(F.col("id"), 256).alias("virtual_slot"), (F.col("id") % 100 + 1).alias("size"))
    loads = sharding.slot_bytes(records, 256)
    first = sharding.first_map(spark, 8, 256)
    second = sharding.rebalance(first, loads, 9)
    path = str(tmp_path / "map")
    sharding.save_map(first, path)
    sharding.save_map(second, path)
    assert sharding.load_map(spark, path).first().version == 2 and sharding.load_map(spark, path, 1).count() == 256
    old, new = ({r.virtual_slot: r.shard for r in m.collect()} for m in (first, second))
    moved = [s for s in old if old[s] != new[s]]
    assert set(new.values()) == set(range(9)) and len(moved) < 60
    sums, sizes = Counter(), {r.virtual_slot: r.bytes for r in loads.collect()}
    for slot, size in sizes.items():
        sums[new[slot]] += size
    assert all(abs(s - sum(sizes.values()) / 9) <= max(sizes.values()) for s in sums.values())


def test_chunks_of_one_text_give_the_same():
    """Texts are read in chunks; a chunk of nothing but an empty text is one of them."""
    from facetry.llm import decontaminate

    rng = random.Random(12)
    texts = [words(rng, rng.randrange(1, 60)).encode() for _ in range(8)] + [b"", b" \n ", "é Licensed under CC BY-NC 4.0. é".encode(), b"", b"..."]
    index = decontaminate.WindowIndex([("a", texts[0]), ("b", b"w1")])
    scanner = license_scan.LicenseScanner([(n, t.encode()) for n, t in license_scan.NOTICES], 0.8)
    model = language_id.LanguageModel.fit({"x": [texts[1].decode()], "y": [texts[2].decode()]})
    tokens, hasher = lm_scoring.Tokens(), quality.WordHasher()
    for run in (
        lambda c: [str(r) for r in index.scan(c, True)],
        lambda c: [str(r) for r in scanner.scan(c)],
        lambda c: [f"{a} {b:.9f}" for a, b in zip(*model.predict(c), strict=True)],
        lambda c: [str(v) for v in np.bincount(tokens.read(c)[2], minlength=len(c))],
        lambda c: [str(v) for v in tokens.read(c)[0]],
        lambda c: [str(r.round(9).tolist()) for r in quality.content_view(c, hasher)],
        lambda c: [str(r.round(9).tolist()) for r in quality.metadata_view(c, [None] * len(c), ["s"] * len(c), [1] * len(c))],
    ):
        assert run(texts) == [v for t in texts for v in run([t])]
