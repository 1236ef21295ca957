"""Matching of many classes by auction: the cost of the dense route, a proven gap, and sizes that have no matrix."""

import numpy as np
import pytest

from facetry.operators import scoring as S
from facetry.operators.matching import auction

COUNTS = "true_label int, pred_label int, n bigint"


def table_of(spark, cells):
    return spark.createDataFrame([(int(t), int(p), int(n)) for t, p, n in cells], COUNTS)


def cost(rows):
    """The summed 1 / (1 + n / total) of a matching."""
    return sum(1 / (1 + r.n / r.total) for r in rows)


def sparse_counts(rng, rows, columns, share, most):
    at = np.argwhere(rng.random((rows, columns)) < share)
    return [(t * 3 - 5, p * 2, n) for (t, p), n in zip(at, rng.integers(1, most + 1, len(at)))]


@pytest.mark.parametrize("rows,columns,share,most", [(30, 30, 0.2, 50), (20, 35, 0.3, 3), (35, 20, 0.3, 3), (25, 25, 0.9, 1), (40, 40, 0.06, 5)])
def test_costs_as_much_as_the_dense_route(spark, rows, columns, share, most):
    """Also with many ties, with more classes on one side, and where classes stay single."""
    counts = table_of(spark, sparse_counts(np.random.default_rng(rows + columns), rows, columns, share, most)).repartition(3)
    dense, sparse = S.match_classes(counts).collect(), S.match_many_classes(counts).collect()
    assert cost(sparse) == pytest.approx(cost(dense), abs=1e-7)
    assert [c for c in sparse[0].__fields__] == [c for c in dense[0].__fields__]
    for both in (dense, sparse):
        used = [r.pred_label for r in both if r.pred_label is not None]
        assert len(used) == len(set(used))
    want = {r.true_label: (r.n_true, r.total, r.pred_label is None) for r in dense}
    assert len(want) == len(sparse) and sum(r.pred_label is None for r in dense) == sum(r.pred_label is None for r in sparse)
    assert all((r.n_true, r.total) == want[r.true_label][:2] for r in sparse)
    assert S.accuracy(S.match_many_classes(counts)).first()[0] == pytest.approx(sum(r.n for r in sparse) / sparse[0].total)


def test_gap_is_proven(spark):
    """The sum is below the optimum by no more than the gap, and the gap is small; blocks of any size give one result."""
    rng = np.random.default_rng(3)
    counts = table_of(spark, sparse_counts(rng, 60, 60, 0.15, 9))
    found = auction(counts, "n")
    cells = {(r.true_label, r.pred_label): r.n for r in counts.collect()}
    benefit = np.array([[cells.get((t, p), 0) for p in found.columns] for t in found.rows], float)
    partner = S.assignment(-benefit)
    best = sum(benefit[i, j] for i, j in enumerate(partner) if j >= 0)
    assert best - 1e-6 <= found.benefit + found.gap and found.gap < 1e-6 * best
    assert found.benefit == pytest.approx(best)
    again = auction(counts.repartition(7), "n", block_pairs=11)
    assert again.benefit == pytest.approx(best)


def test_rounds_in_spark(spark):
    """With the pairs left in Spark the sum is within the proven gap of the optimum too."""
    counts = table_of(spark, sparse_counts(np.random.default_rng(4), 12, 12, 0.25, 40)).repartition(2)
    one = auction(counts, "n")
    two = auction(counts, "n", tolerance=1e-2, local_pairs=0)
    assert one.gap < 1e-6 * one.benefit and two.benefit <= one.benefit + 1e-9 <= two.benefit + two.gap + 1e-6
    assert two.gap <= 1e-2 * 40 * 24 + 1e-9


def test_empty_and_single(spark):
    assert S.match_many_classes(table_of(spark, [])).count() == 0
    assert [(r.true_label, r.pred_label, r.n) for r in S.match_many_classes(table_of(spark, [(4, 9, 3)])).collect()] == [(4, 9, 3)]
    one = S.match_many_classes(table_of(spark, [(1, 7, 5), (2, 7, 6)])).collect()
    assert {(r.true_label, r.pred_label, r.n) for r in one} == {(2, 7, 6), (1, None, 0)}
    zeros = S.match_many_classes(table_of(spark, [(1, 7, 5), (1, 8, 0), (2, 7, 0), (2, 8, 0)])).collect()
    assert {(r.true_label, r.pred_label, r.n) for r in zeros} == {(1, 7, 5), (2, 8, 0)}
