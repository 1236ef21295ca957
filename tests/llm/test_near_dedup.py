"""Near duplicates by similarity: against all pairs, on awkward rows, in hot bands, and how many planted pairs are found."""

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry.llm import mixing, near_dedup, quality

from .helpers import awkward, empty, labels, words
from .test_brute_force import roots


def plain_shingles(text, width=5):
    """Distinct runs of ``width`` words; fewer words are one run, none an empty set."""
    w = ["".join(c.lower() if c.isascii() else c for c in x) for x in (text or "").split()]
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def plain_similarity(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def plain_components(rows, least=0.8):
    """Smallest key of each row's component over all pairs."""
    sets = [plain_shingles(t) for _, t in rows]
    found = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if plain_similarity(sets[i], sets[j]) >= least])
    low = {}
    for (key, _), root in zip(rows, found, strict=True):
        if key is not None:
            low[root] = min(key, low.get(root, key))
    return [(key, low.get(root)) for (key, _), root in zip(rows, found, strict=True)]


def by_key(pairs):
    return sorted(pairs, key=str)


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


def test_against_all_pairs(spark):
    """Groups around a centre, chains, exact copies and single documents."""
    rng = random.Random(11)
    texts = []
    for _ in range(6):
        base = words(rng, 160, 5000)
        texts += [base, base] + [edited(rng, base, rng.randrange(1, 5)) for _ in range(8)]
        chain = base
        for _ in range(4):
            chain = edited(rng, chain, 2)
            texts.append(chain)
    texts += [words(rng, 40, 5000) for _ in range(40)] + ["a b c d", "A  b c\td", "a b c", ""]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = [(r.doc_id, r.component_id) for r in near_dedup.similar_documents(docs).collect()]
    assert by_key(got) == by_key(plain_components(rows))


@pytest.mark.parametrize("hubs", [(1, 64), (1, 2), ()])
def test_hot_band(spark, monkeypatch, hubs):
    """One group whose pairs lie about the threshold, so that no hub links all: the links do not depend on how many hubs come first."""
    monkeypatch.setattr(near_dedup, "STAR_HUBS", hubs)
    rng = random.Random(12)
    base = words(rng, 200, 9000)
    rows = list(enumerate(edited(rng, base, rng.choice((2, 3, 4, 6, 9))) for _ in range(150)))
    got = near_dedup.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert by_key((r.doc_id, r.component_id) for r in got) == by_key(plain_components(rows))


def test_recall_of_planted_pairs(spark):
    """Of 400 pairs of a similarity from 0.8 to 0.86, each alone with its partner, at least 99 % are linked."""
    rng = random.Random(13)
    rows, pairs = [], 0
    while pairs < 400:
        base = words(rng, rng.randrange(60, 300), 50_000)
        other = edited(rng, base, max(1, len(base.split()) // 50))
        if 0.8 <= plain_similarity(plain_shingles(base), plain_shingles(other)) <= 0.86:
            rows += [(2 * pairs, base), (2 * pairs + 1, other)]
            pairs += 1
    got = near_dedup.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string"))
    linked = got.where("doc_id % 2 = 1 AND component_id = doc_id - 1").count()
    print(f"{linked} of {pairs} planted pairs of similarity 0.8 to 0.86 are linked")
    assert linked >= 396


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = [(r.doc_id, r.component_id) for r in near_dedup.similar_documents(docs).collect()]
    assert by_key(got) == by_key(plain_components(rows))
    assert near_dedup.similar_documents(empty(spark)).count() == 0
    # Repeated rows are one document, rows without key stay, clashing columns pass through.
    clash = docs.withColumn("gone", F.lit(1)).withColumn("band", F.lit("b")).withColumn("of", F.lit(2))
    kept = near_dedup.drop_near_duplicates(clash, similarity=0.8)
    assert kept.columns == clash.columns
    want = [key for key, low in plain_components(rows) if key is None or key == low]
    assert by_key(r.doc_id for r in kept.collect()) == by_key(want)
    assert near_dedup.drop_near_duplicates(empty(spark), similarity=0.8).count() == 0


def test_awkward_rows_of_other_stages(spark):
    docs = awkward(spark)
    for name in ("__quality", "__key", "__y", "__copies", "quality_score", "of_key", "copies_of", "rows_of", "take_no"):
        docs = docs.withColumn(name, F.lit("clash"))
    kept = quality.keep_quality(docs, labels(spark))
    assert kept.columns == docs.columns and kept.where("doc_id IN (100, 101)").count() == 0
    assert quality.keep_quality(empty(spark), labels(spark)).count() == 0
    mix = mixing.mix_sources(docs)
    taken = mixing.repeat_documents(docs, mix)
    assert taken.columns == docs.columns and taken.where("doc_id = 100").count() == 0
    alone = {r.doc_id: r.copies for r in mix.groupBy("doc_id").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("rows = 1").collect()}
    counts = {r.doc_id: r["count"] for r in taken.groupBy("doc_id").count().collect()}
    assert all(counts.get(key, 0) == copies for key, copies in alone.items())
    assert mixing.repeat_documents(empty(spark), mixing.mix_sources(empty(spark))).count() == 0


def test_links_come_from_fingerprints(spark, monkeypatch):
    """The covering code's candidates alone link exact and very light edits: no band is needed for them, and each is checked by its shingles."""
    monkeypatch.setattr(near_dedup, "band_keys", lambda hashes, sizes, bands: near_dedup.mix64(np.arange(int((sizes > 0).sum()) * bands) + hashes[:1].sum()).reshape(-1, bands).view(np.int64))
    rng = random.Random(14)
    base = words(rng, 4000, 50_000)
    rows = [(0, base), (1, edited(rng, base, 1)), (2, words(rng, 4000, 50_000)), (3, "a b c d e f"), (4, "f e d c b a")]
    got = near_dedup.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)).collect()
    assert by_key((r.doc_id, r.component_id) for r in got) == [(0, 0), (1, 0), (2, 2), (3, 3), (4, 4)]


def test_rows_of_a_hot_band_grow_with_its_members(spark, monkeypatch):
    """Members that no hub reaches meet within a task, as pairs of parts if they are many: rows do not grow with pairs, and no link is lost."""
    rng = random.Random(15)
    base = words(rng, 200, 9000)
    rows = list(enumerate(edited(rng, base, rng.choice((2, 3, 4, 6, 9))) for _ in range(150)))
    docs, want = spark.createDataFrame(rows, "doc_id bigint, text string"), by_key(plain_components(rows))
    monkeypatch.setattr(near_dedup, "STAR_HUBS", ())
    most, settle = [], near_dedup.settle

    def noted(df, name):
        out = settle(df, name)
        most.append(0 if name == "anchors" else out.count())
        return out

    monkeypatch.setattr(near_dedup, "settle", noted)
    for shingles in (1 << 20, 3000):
        got = near_dedup.similar_documents(docs, part_shingles=shingles).collect()
        assert by_key((r.doc_id, r.component_id) for r in got) == want
    assert max(most) <= 150 * near_dedup.band_count(0.8)


def test_fingerprints_of_sets():
    hashes, sizes = near_dedup.shingle_sets([b"", b"a b c d e f g", b"one", b"x y z " * 50])
    got = near_dedup.set_fingerprints(hashes, sizes, step=3).view(np.uint64).tolist()
    want = [sum(1 << k for k in range(64) if 2 * sum(int(h) >> k & 1 for h in s) > len(s)) for s in np.split(hashes, np.cumsum(sizes)[:-1])]
    assert got == want


def test_pairs_of_a_hot_band_grow_with_its_members(spark, monkeypatch, tmp_path):
    """What is joined as pairs of texts is a few rows a document, however many members of a band lie apart from its centre; the rest meet within tasks."""
    rng = random.Random(16)
    base = words(rng, 200, 9000)
    rows = list(enumerate(edited(rng, base, rng.choice((4, 6, 9))) for _ in range(300)))
    similar = near_dedup._similar

    def counted(least, width):
        def run(batches):
            for batch in batches:
                (tmp_path / uuid.uuid4().hex).write_text(str(batch.num_rows))
                yield from similar(least, width)(iter([batch]))

        return run

    monkeypatch.setattr(near_dedup, "_similar", counted)
    got = near_dedup.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert by_key((r.doc_id, r.component_id) for r in got) == by_key(plain_components(rows))
    joined = sum(int(p.read_text()) for p in tmp_path.iterdir())
    print(f"{joined} pairs of texts joined")
    assert joined <= 10 * len(rows)
