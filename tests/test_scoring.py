"""Contingency, matching and scores."""

import itertools

import numpy as np
import pytest

from facetry.operators import scoring as S
from facetry.plans import compare as C

from .conftest import features


@pytest.mark.parametrize("seed", range(25))
def test_assignment_is_optimal(seed):
    rng = np.random.default_rng(seed)
    rows, columns = (int(v) for v in rng.integers(1, 6, 2))
    cost = rng.random((rows, columns)).round(int(rng.integers(1, 3)))
    match = S.assignment(cost)
    used = [j for j in match if j >= 0]
    assert len(used) == len(set(used)) == min(rows, columns)
    total = sum(cost[i, j] for i, j in enumerate(match) if j >= 0)
    if rows <= columns:
        best = min(sum(cost[i, p] for i, p in enumerate(ps)) for ps in itertools.permutations(range(columns), rows))
    else:
        best = min(sum(cost[p, j] for j, p in enumerate(ps)) for ps in itertools.permutations(range(rows), columns))
    assert total == pytest.approx(best)


def table(spark, pairs):
    rows = [(i, t, p) for i, (t, p) in enumerate(pairs)]
    return S.contingency(spark.createDataFrame(rows, "row_id bigint, true_label int, pred_label int"))


def test_contingency_fills_zeros(spark):
    rows = {(r.true_label, r.pred_label): r.n for r in table(spark, [(0, 7), (0, 7), (1, 9)]).collect()}
    assert rows == {(0, 7): 2, (0, 9): 0, (1, 7): 0, (1, 9): 1}


def test_perfect_labels_score_one(spark):
    matching = S.match_classes(table(spark, [(k % 3, 10 - k % 3) for k in range(30)]))
    assert S.accuracy(matching).first()[0] == 1.0
    f = S.f_measure(matching).first()
    assert f.f1 == pytest.approx(1.0) and f.f1_of_means == pytest.approx(1.0)


def test_unmatched_true_class_scores_zero(spark):
    pairs = [(0, 1)] * 6 + [(1, 2)] * 3 + [(2, 1)]
    matching = S.match_classes(table(spark, pairs))
    rows = {r.true_label: (r.pred_label, r.n) for r in matching.collect()}
    assert rows == {0: (1, 6), 1: (2, 3), 2: (None, 0)}
    assert S.accuracy(matching).first()[0] == pytest.approx(0.9)
    f = S.f_measure(matching).first()
    assert f.f1 == pytest.approx((2 * (6 / 7) / (6 / 7 + 1) + 1) / 2)


def test_labels_must_line_up(spark):
    a = spark.createDataFrame([(1, 0), (2, 0)], "row_id bigint, true_label int")
    b = spark.createDataFrame([(1, 0)], "row_id bigint, pred_label int")
    with pytest.raises(Exception, match="row_id 2"):
        S.label_pairs(a, b).collect()


def test_compare_methods(spark):
    rng = np.random.default_rng(0)
    labels = np.arange(90) % 3
    x = np.eye(3)[labels] + 0.02 * rng.random((90, 3))
    df = features(spark, x, np.arange(90) % 2, labels)
    methods = C.default_methods(3, seed=2, lam=0.01, max_iter=3)
    scores = {r["method"]: r for r in C.compare(df, {k: methods[k] for k in ("kmeans", "nmf", "agd")}).collect()}
    assert scores["kmeans"].accuracy == 1.0 and scores["nmf"].accuracy == 1.0
    assert scores["agd"].accuracy > 0.6
    assert all(r.seconds > 0 for r in scores.values())
