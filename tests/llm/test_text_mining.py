"""Secret scans, spelling variants and collocations against plain versions."""

import hashlib
import random
import re
import string
import uuid
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from facetry.llm import collocations, secret_scan, spelling
from facetry.llm.queries import QUERIES

from .helpers import awkward, empty, words

SF = "/root/testdata/sf0.001"


def plain_spans(text):
    """Base spans: every match of the three patterns, those that are too short dropped."""
    found = []
    low = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found += [(m.start(), 0, m.end()) for m in re.finditer(low, text, re.I | re.A) if len(m.group(2)) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(found)


def base_digest(spans):
    return hashlib.sha256(",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()


def test_base_spans_of_the_table(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op11_secrets"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_spans(texts[r.doc_id])
        assert r.base_sha256 == base_digest(want)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for _, k, _ in want) for kind in range(3))
        assert [s for s in r.spans.split(",") if s and not s.startswith("novel")] == [f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in want]


TRICKY = [
    'é password:token:abcdefg PassWord = "aaaaaa" tokén=abcdef',
    "API_KEY='abcdef1' apikey:: x api_key:abc.def= SECRET=short",
    "AKIAAKIA" + "A1" * 8 + " AKIA123 AKIA" + "Z" * 15 + " xAKIA" + "Z" * 16,
    "0123456789abcdef01234567 g0123456789abcdef0123456 " + "f" * 24 + "é" + "0" * 30,
    "KEY paſſword=abcdefgh passwd\n=\nabcdefgh secret  =  ''abcdefgh",
]


def test_base_spans_of_tricky_texts(spark):
    docs = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id int, text string")
    for r in secret_scan.scan_secrets(docs, b"").collect():
        got = [(s.start, secret_scan.KINDS.index(s.kind), s.end) for s in r.secret_scan.spans if s.kind != "novel"]
        assert got == plain_spans(TRICKY[r.doc_id])
        for s in r.secret_scan.spans:
            assert TRICKY[r.doc_id][s.start : s.end].endswith(s.value)


def test_novelty_tells_secrets_from_identifiers(spark):
    """Random keys after a sensitive word are found; identifiers made of the corpus' words are not; nor is a key without such a word."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice(("ka", "lo", "mi", "ren", "tu", "sas", "vel", "dor")) for _ in range(rng.randrange(2, 5))) for _ in range(300)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(120)) for _ in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    dictionary = secret_scan.identifier_dictionary(docs)
    assert dictionary and set(dictionary.decode().split()) <= set(" ".join(texts).split())
    scanner = secret_scan.NoveltyScanner(dictionary)
    key = lambda: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(32))
    name = lambda: "_".join(rng.choice(vocabulary) for _ in range(4)) + "1"
    hits = {}
    for kind, lead, make in (("key", "bearer ", key), ("name", "bearer ", name), ("far", "kalo ", key)):
        hits[kind] = 0
        for i in range(200):
            raw = (texts[i][:300] + "\n" + lead + make() + " " + texts[i][300:]).encode()
            hits[kind] += any(s[1] == 3 for s in scanner.spans(raw))
    assert hits["key"] >= 196 and hits["name"] <= 10 and hits["far"] == 0


def test_redaction(spark):
    docs = spark.createDataFrame([(1, 'é token = "abcdef123456" end'), (2, "nothing"), (3, None)], "doc_id int, text string")
    got = {r.doc_id: r.secret_scan for r in secret_scan.scan_secrets(docs, b"", redact=True).collect()}
    assert got[1].redacted == 'é token = "[secret]" end' and got[2].redacted is None and got[3].spans == []


def test_secrets_of_awkward_rows(spark):
    docs = awkward(spark)
    got = secret_scan.scan_secrets(docs, secret_scan.identifier_dictionary(docs))
    assert got.count() == docs.count() and got.columns == [*docs.columns, "secret_scan"]
    assert secret_scan.identifier_dictionary(empty(spark)) == b""
    assert secret_scan.scan_secrets(empty(spark), b"").count() == 0
    assert secret_scan.scan_secrets(docs.withColumn("secret_scan", F.lit(1)), b"").where("size(secret_scan.spans) > 0").count() == 0


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain_groups(counts, dominance=10):
    out = {}
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w in counts:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= dominance * counts[w] else None
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (counts[w], len(near[w]), form[w], counts[form[w]] if form[w] else None, root)
    return out


@pytest.mark.parametrize("hot", [256, 1])
def test_spelling_against_all_pairs(spark, hot):
    """All pairs of words, also where every key counts as crowded and is split down to single code points."""
    rng = random.Random(2)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randrange(7, 12))) for _ in range(60)]
    counts = {}
    for stem in stems:
        counts[stem] = rng.choice((2, 30, 400, 5000, 70000))
        for _ in range(6):
            chars, at = list(stem), rng.randrange(len(stem))
            kind = rng.randrange(3)
            chars[at : at + (kind < 2)] = [] if kind == 0 else [rng.choice("abéz")]
            counts.setdefault("".join(chars), rng.choice((2, 3, 25, 390)))
    counts |= {"a" * n: 10**k for k, n in enumerate(range(7, 13), 1)} | {"x" * 40: 5, "x" * 39 + "y": 50}
    counts = {w: n for w, n in counts.items() if len(w) >= 6}
    table = spark.createDataFrame([(w, n, "clash", 1) for w, n in counts.items()], "word string, n bigint, a string, key int")
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.group_spellings(table, hot=hot).collect()}
    assert got == plain_groups(counts)


def plain_words(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'null' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7}


def test_words_of_awkward_rows(spark):
    rng = random.Random(8)
    rows = [(i, " ".join("".join(rng.choice("abcÉé") for _ in range(rng.randrange(5, 10))) for _ in range(60))) for i in range(30)]
    rows += [(None, "Einzeln ALLEINE alleine"), (7, None), (8, ""), (9, "x" * 50000 + " ÀÀÀÀÀÀÀ×ÀÀÀÀÀÀÀ"), rows[3], rows[3]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("word", F.lit(1)).withColumn("key", F.lit("k")).withColumn("run", F.lit("r"))
    assert {r.word: r.n for r in spelling.noisy_words(docs).collect()} == plain_words(rows)
    assert spelling.spelling_variants(awkward(spark)).count() >= 0
    assert spelling.spelling_variants(empty(spark)).count() == 0
    variants = spark.createDataFrame([("alleinn", 2, 1, "alleine", 20, "alleine")], "word string, n bigint, n_near bigint, form string, form_n bigint, root string")
    texts = spark.createDataFrame([(1, "Ja, ALLEINN!"), (1, "Ja, ALLEINN!"), (2, None), (3, "..")], "doc_id int, text string")
    got = sorted((r.doc_id, r.unified) for r in spelling.unify_spellings(texts, variants).where("text is not null").collect())
    assert got == [(1, ["ja", "alleine"]), (1, ["ja", "alleine"]), (3, [])]


def plain_phrases(rows, width, least, top):
    """Counts by n-gram, as the definition has it."""
    count, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", "".join(c.lower() if c.isascii() else c for c in text or "")):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            total[lang] += len(w)
            for k in range(1, width + 1):
                count[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in count.items():
        held = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in held.items():
            if any(b >= a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in held.items()):
                continue
            score, cut = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:cut]], f[p[cut:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("bits", [27, 6])
def test_collocations_against_counts(spark, bits):
    """Also with a filter so small that it lets almost all pairs pass: nothing changes but the number of edges."""
    rng = random.Random(4)
    texts = [(rng.choice(("en", "fr", None, "und")), ". ".join(words(rng, rng.randrange(0, 14), 9) for _ in range(8))) for _ in range(120)]
    chant = "one two three four five six seven eight nine ten eleven twelve"
    texts += [("en", chant + "! la la la la la la\tla  la, É é x " + chant)] * 12 + [("fr", "Allez ALLEZ allez" * 3), ("fr", None), (None, ""), ("de", " ,. ")]
    docs = spark.createDataFrame([(i, t, lang, "n", 1) for i, (lang, t) in enumerate(texts)], "doc_id int, text string, lang string, n string, k int")
    got = collocations.collocations(docs, least=8, top=40, bits=bits).collect()
    assert sorted(tuple(r) for r in got) == plain_phrases(texts, 5, 8, 40)


def test_paths_hold_all_edges(spark):
    """Compaction loses no edge and no weight: windows of the paths are the edges, chains are one row, cycles and long chains stay whole."""
    def grams(text, n):
        w = text.split()
        return [("en", " ".join(w[i : i + 5]), n) for i in range(len(w) - 4)]

    chain = " ".join(f"c{i}" for i in range(12))
    long = " ".join(f"x{i}" for i in range(80))
    loop = " ".join(["p q r s t u v"] * 2 + ["p q r s"])[: len("p q r s t u v p q r s")]
    rows = grams(chain, 3) + grams(long, 2) + grams(loop, 5) + grams("la la la la la", 4) + grams("c3 c4 c5 c6 zz", 1)
    table = spark.createDataFrame(rows, "lang string, gram string, n bigint")
    paths = collocations.unary_paths(table).collect()
    windows = sorted((r.lang, " ".join(r.words[i : i + 5]), r.n) for r in paths for i in range(len(r.words) - 4))
    assert windows == sorted(rows)
    assert len(paths) < len(rows) - 20 and max(len(r.words) for r in paths) > 15
    assert all(not ("c6" in r.words and "c7" in r.words and "c2" in r.words) for r in paths)


def test_phrases_of_awkward_rows(spark):
    got = collocations.collocations(awkward(spark), least=2).collect()
    assert got and all(r.lang in ("en", "fr", "und") and r.a >= 2 for r in got)
    assert collocations.collocations(empty(spark), least=2).count() == 0


@pytest.mark.parametrize("most", [1 << 18, 30])
def test_edges_are_summed_over_a_task(most):
    """Grams that many chunks of texts share are one row of a task, or of a part of it that holds enough grams; every word is in exactly one row."""
    rng = random.Random(21)
    texts = [" ".join(words(rng, 12, 6).split()) + ". Alone! two  \t words" for _ in range(40)]
    every = type("Shared", (), {"value": np.full(1 << 4, np.uint64(2**64 - 1))})()
    batches = lambda: (pa.RecordBatch.from_pydict({"lang": ["en"] * 40, "text": [t.encode() for t in texts]}) for _ in range(25))
    got = [r for batch in collocations._edges(every, 10, 5, most)(batches()) for r in batch.to_pylist()]
    want = Counter()
    for t in texts:
        for piece in re.split(r"[.!]", t.lower()):
            w = piece.split()
            want.update((" ".join(w[i : i + 5]), min(5, len(w) - i)) for i in range(len(w)))
            want[None, 0] += len(w)
    found = Counter()
    for r in got:
        found[r["gram"], r["k"]] += r["n"]
    assert found == Counter({gram: 25 * n for gram, n in want.items()})
    if most > len(want):
        assert len(got) == len(want)


def test_rare_grams_make_no_rows(spark):
    """Grams of words, pairs and triples that are all frequent end where they are rare themselves: what is written are frequent phrases, not all that occur."""
    rng = random.Random(22)
    texts = [words(rng, 60, 4) for _ in range(300)]
    docs = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string")
    paths, ends, totals = collocations.phrase_graph(docs, least=100)
    counts = Counter(" ".join(w[i : i + k]) for w in map(str.split, texts) for k in range(1, 6) for i in range(len(w) - k + 1))
    frequent = {phrase for phrase, n in counts.items() if n >= 100}
    assert {r.gram for r in ends.collect()} <= frequent and paths.count() == 0
    got = {r.phrase: r.n for r in collocations.phrase_counts(paths, ends).where("n >= 100").collect()}
    assert got == {phrase: counts[phrase] for phrase in frequent}


def test_rows_of_grams_do_not_grow_with_tasks(spark):
    """Each frequent phrase is written out by the task of one text, or few, however many tasks hold it, and its count is that of all of them."""
    rng = random.Random(23)
    texts = [words(rng, 40, 12).replace(" ", " x ", 3) + f". only {i}" for i in range(400)]
    docs = spark.createDataFrame([("en", t.encode()) for t in texts], "lang string, text binary")
    filled, counted = collocations.frequent_keys(docs, least=20)
    counts = Counter(" ".join(w[i : i + k]) for t in texts for piece in t.lower().split(".") for w in [piece.split()] for k in range(1, 6) for i in range(len(w) - k + 1))
    frequent = {phrase: n for phrase, n in counts.items() if n >= 20}
    shared = lambda value: type("Shared", (), {"value": value})()
    run = collocations._edges(shared(filled), collocations.FILTER_BITS, 5, named=shared(collocations._names(counted, collocations.FILTER_BITS)))
    n_of = {r.key: r.n for r in counted.collect()}
    for size in (400, 10, 1):  # texts of a task
        tasks = [texts[i : i + size] for i in range(0, len(texts), size)]
        rows = [r for t in tasks for b in run(iter([pa.RecordBatch.from_pydict({"lang": ["en"] * len(t), "text": [x.encode() for x in t]})])) for r in b.to_pylist()]
        assert sum(r["n"] for r in rows if r["k"] == 0) == sum(n for phrase, n in counts.items() if " " not in phrase)
        grams = [r for r in rows if r["k"]]
        assert {r["gram"]: n_of[r["key"]] for r in grams if r["key"] in n_of} == frequent
        assert len(grams) < 1.1 * len(frequent) + 10


def test_phrases_of_texts_that_change_between_passes(spark):
    """Which text writes a phrase out depends on its words; texts that an unseeded function makes differ in every pass, and no phrase is lost."""
    other = F.udf(lambda: uuid.uuid4().hex, "string").asNondeterministic()
    docs = spark.range(300).select(F.lit("en").alias("lang"), F.concat(F.lit("one two three four five six. "), other()).alias("text"))
    got = {(r.phrase, r.a, r.n) for r in collocations.collocations(docs, least=100).collect()}
    assert got == {("one two three four five", 300, 2100), ("two three four five six", 300, 2100)}
