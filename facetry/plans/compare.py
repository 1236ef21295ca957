"""Rivals, the comparison of methods on one labelled table, and the variance experiment."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import basis as B
from ..operators.blocks import small_table
from ..operators.group_stats import GRAM, read_state, state_from_cells, weighted_statistics
from ..operators.kmeans import kmeans, nearest_labels
from ..operators.scoring import accuracy, f_measure, joint_counts, label_pairs, match_classes
from ..sources.noise import add_gaussian
from ..sources.planted import planted
from .factorize import alternate, factorize
from .separable_nmf import separable_nmf

Method = Callable[[DataFrame], DataFrame]


def kmeans_labels(df: DataFrame, classes: int, seed: int = 0, max_iter: int = 100, keep: Sequence[str] = ()) -> DataFrame:
    """``row_id, pred_label`` by K-Means (k-means|| start); columns to keep come between. The labels do not depend on the table's layout."""
    return nearest_labels(df, kmeans(df, classes, seed, max_iter), keep)


def nmf_labels(df: DataFrame, classes: int, keep: Sequence[str] = ()) -> DataFrame:
    return separable_nmf(df, classes).labels(df, keep)


def default_methods(classes: int, seed: int = 0, **fit_options) -> dict[str, Method]:
    """K-Means, separable NMF and the three solvers of the factorisation; each keeps the true label beside its own."""
    keep = ("label",)
    methods: dict[str, Method] = {
        "kmeans": lambda df: kmeans_labels(df, classes, seed, keep=keep),
        "nmf": lambda df: nmf_labels(df, classes, keep),
    }
    for solver in ("agd", "admm", "cease"):
        methods[solver] = lambda df, s=solver: factorize(df, classes, solver=s, seed=seed, **fit_options).labels(df, keep)
    return methods


def evaluate(df: DataFrame, predicted: DataFrame) -> tuple[float, float, float]:
    """(accuracy, mean F1, F1 of means) of predicted labels against column ``label``: of ``predicted`` if it has one, else of ``df`` by key."""
    if "label" in predicted.columns:
        pairs = predicted.select(F.col("label").alias("true_label"), "pred_label")
    else:
        pairs = label_pairs(df.select("row_id", F.col("label").alias("true_label")), predicted)
    matching = match_classes(joint_counts(pairs))
    score, f1 = accuracy(matching).first()[0], f_measure(matching).first()
    return float(score), float(f1["f1"] or 0.0), float(f1["f1_of_means"] or 0.0)


def compare(df: DataFrame, methods: Mapping[str, Method]) -> DataFrame:
    """``method, accuracy, f1, f1_of_means, seconds`` per method; seconds cover fitting and scoring."""
    rows = []
    for name, method in methods.items():
        began = time.monotonic()
        scores = evaluate(df, method(df))
        rows.append((name, *scores, time.monotonic() - began))
    return small_table(
        df.sparkSession, rows, "method string, accuracy double, f1 double, f1_of_means double, seconds double"
    )


def cell_variances(estimates: DataFrame) -> DataFrame:
    """Sample variance over ``run`` of every cell of repeated estimates ``method, run, i, j, value``."""
    return estimates.groupBy("method", "i", "j").agg(F.var_samp("value").alias("variance"))


def variance_ratio(estimates: DataFrame, numerator: str = "aware", denominator: str = "plain") -> DataFrame:
    """Mean cell variance of one method over that of another."""
    means = cell_variances(estimates).agg(
        F.avg(F.when(F.col("method") == numerator, F.col("variance"))).alias("a"),
        F.avg(F.when(F.col("method") == denominator, F.col("variance"))).alias("b"),
    )
    return means.select((F.col("a") / F.col("b")).alias("ratio"))


@dataclass
class VarianceExperiment:
    estimates: DataFrame
    theory_plain: np.ndarray
    theory_aware: np.ndarray


def variance_experiment(
    keys: DataFrame,
    basis: np.ndarray,
    sigmas: Sequence[float],
    repeats: int,
    *,
    solver: str = "admm",
    hyper: float = 100.0,
    inner_iter: int = 50,
    rounds: int = 2,
    p: float = 0.5,
    seed: int = 0,
) -> VarianceExperiment:
    """Repeat the noise, not the weights, and estimate the basis plainly and noise-aware each time.

    All repeats are one Spark pass: a repeat is a set of extra groups, and its noise is keyed by it. Each
    repeat's estimates are then made from its own summed statistics, in parallel. The Gram matrices that theory needs do not depend on noise
    and come from the clean table.
    """
    basis = np.asarray(basis, dtype=float)
    width, rank = basis.shape
    c = len(sigmas)
    clean = planted(keys, basis, weights="bernoulli", p=p, seed=seed)
    copies = clean.select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("_run"))
    level = F.get(F.array(*[F.lit(float(s)) for s in sigmas]), F.col("group_id"))
    copies = copies.withColumn("_sd", level).select(
        (F.col("row_id") * F.lit(repeats) + F.col("_run")).alias("row_id"),
        (F.col("_run") * F.lit(c) + F.col("group_id")).cast("int").alias("group_id"),
        "features",
        "h",
        "_sd",
    )
    noisy = add_gaussian(copies, F.col("_sd"), seed + 1).drop("_sd")
    stats = weighted_statistics(noisy)
    clean_grams = weighted_statistics(clean).filter(F.col("kind") == GRAM)
    grams = read_state(clean_grams, np.arange(c), width, rank, with_cross=False).gram

    def estimate(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        run = int(key[0])
        state = state_from_cells(*(pdf[k].to_numpy() for k in ("group_id", "kind", "i", "j", "value")),
                                 np.arange(run * c, (run + 1) * c), width, rank)
        parts = []
        for name, aware in (("plain", False), ("aware", True)):
            w, _ = alternate(state, width, np.zeros((width, rank)), solver, hyper, aware, rounds, inner_iter)
            i, j = np.indices(w.shape)
            parts.append(pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "value": w.ravel()}).assign(method=name, run=run))
        return pd.concat(parts)

    estimates = (
        stats.withColumn("run", F.floor(F.col("group_id") / c).cast("int"))
        .groupBy("run")
        .applyInPandas(estimate, "method string, run int, i int, j int, value double")
    )
    plain, aware = B.estimate_variance(grams, np.asarray(sigmas), hyper)
    return VarianceExperiment(estimates, plain, aware)
