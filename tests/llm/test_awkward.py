"""Every operator on awkward rows and on an empty table: defined results, one per row, whatever else the table carries."""

import pytest
from pyspark.sql import functions as F

from facetry.llm import decontaminate, language_id, license_scan, line_dedup, lm_scoring, mixing, near_dedup, quality, sharding, vector_search

from .helpers import awkward, benchmark, empty, labels

HELD = "coalesce(doc_id % 10 = 0, false)"
OPERATORS = {
    "decontaminate": lambda s, d: decontaminate.contamination(d, benchmark(s), clean=True).select("doc_id", "contamination.*"),
    "language": lambda s, d: language_id.with_language(d, language_id.fit_languages(d)).select("doc_id", "language.*"),
    "licenses": lambda s, d: license_scan.scan_licenses(d).select("doc_id", "license_scan.*"),
    "lm": lambda s, d: lm_scoring.score_texts(d, F.expr(HELD)),
    "mix": lambda s, d: mixing.mix_sources(d),
    "near": lambda s, d: near_dedup.near_duplicates(d),
    "quality": lambda s, d: quality.with_quality(d, quality.fit_quality(d, labels(s))).select("doc_id", "quality_score"),
    "shards": lambda s, d: sharding.shard_documents(d, 3),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each(spark, name):
    docs = awkward(spark)
    got = OPERATORS[name](spark, docs)
    assert sorted(str(r[0]) for r in got.select("doc_id").collect()) == sorted(str(r[0]) for r in docs.select("doc_id").collect())
    assert OPERATORS[name](spark, empty(spark)).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_reruns_agree(spark, name):
    docs = awkward(spark)
    one = OPERATORS[name](spark, docs.repartition(1)).collect()
    two = OPERATORS[name](spark, docs.repartition(5)).collect()
    plain = lambda rows: sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)
    if name == "lm":  # sums of logarithms; sampling depends on buckets, which depend on the session alone
        one, two = [[r[:5] for r in x] for x in (one, two)]
    assert plain(one) == plain(two)


def test_lines_of_awkward_rows(spark):
    got = line_dedup.line_classes(awkward(spark))
    assert got.where(F.col("doc_id").isin(100, 101, 102)).count() == 0
    assert got.where("doc_id = 103").count() == 4000
    assert got.where("doc_id is null").count() == 1
    assert line_dedup.line_classes(empty(spark)).count() == 0
    assert line_dedup.dedup_lines(awkward(spark)).count() == awkward(spark).count()
    assert line_dedup.dedup_lines(awkward(spark)).columns == awkward(spark).columns


def test_defined_values(spark):
    docs = awkward(spark)
    language = {r.doc_id: r for r in OPERATORS["language"](spark, docs).collect()}
    assert all(language[i].lang_pred == "und" and language[i].score == 0 for i in (100, 101, 102, 104))
    assert language[None].lang_pred in ("en", "fr")
    scores = {r.doc_id: r.quality_score for r in OPERATORS["quality"](spark, docs).collect()}
    assert scores[100] == scores[101] == 0 and all(0 <= v <= 1 for v in scores.values())
    prints = {r.doc_id: r for r in OPERATORS["near"](spark, docs).collect()}
    assert {prints[i].fingerprint for i in (100, 101, 102)} == {"0" * 16} and {prints[i].component_id for i in (100, 101, 102)} == {100}
    assert prints[None].component_id is None
    shards = {r.doc_id: r for r in OPERATORS["shards"](spark, docs).collect()}
    assert (shards[100].size, shards[100].text_crc32, shards[101].size, shards[105].size) == (8, None, 8, 10)
    lm = {r.doc_id: r for r in OPERATORS["lm"](spark, docs).collect()}
    assert lm[100].n_tokens == lm[101].n_tokens == lm[102].n_tokens == 1 and lm[100].score == lm[101].score < 0
    mixed = {r.doc_id: r for r in OPERATORS["mix"](spark, docs).collect()}
    assert mixed[100].size == mixed[100].taken == 0 and mixed[None].size == 6


def test_vectors(spark):
    rows = [(i, [float(i % 7), -float(i % 5), 0.5]) for i in range(50)] + [(100, None), (200, [None, 1.0, 1.0]), (300, [float("nan"), 0.0, 0.0])]
    rows += [(400, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (500, []), (600, [1.0]), (0, [0.0, 0.0, 0.5])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("v", F.lit("clash")).withColumn("score", F.lit(1))
    vectors = vector_search.integer_vectors(table)
    got = vector_search.top_inner_products(vectors, F.col("vec_id") % 100 == 0, 3, shard_rows=8).collect()
    assert {r.query_id for r in got} == {0}
    assert [r.rank for r in sorted(got, key=lambda r: r.rank)] == [1, 2, 3]
    assert vector_search.top_inner_products(vectors.where("false"), F.col("vec_id") % 100 == 0).count() == 0
