"""One round of fair Lloyd: assignment, per-group means, line search, new centres.

Within a cluster the best centre for the worse-off group lies on the segment between the means
of the two groups (Ghadiri, Samadi, Vempala: Socially Fair k-Means Clustering, 2021). A round
is one aggregate over the points; what follows is arithmetic on one row per centre.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from equipoise.functions.geometry import Centers, center_matrix
from equipoise.operators.moments import CODE_A, CODE_B, MomentTable, PackedPoints, costs_around

# Rounds and first weight of the line search.
LINE_SEARCH_ROUNDS = 10
FIRST_WEIGHT = 0.5

# Costs around the means that keep less than this of the costs around the old centres are not
# taken by subtraction: too few of a double's 16 digits would be left.
LEAST_SHARE = 1e-6


@dataclass(frozen=True)
class FairStep:
    """Everything a round computes, one entry per centre unless noted."""

    n_a: np.ndarray
    n_b: np.ndarray
    mean_a: np.ndarray
    mean_b: np.ndarray
    fixed_a: float
    fixed_b: float
    ell: np.ndarray
    x: np.ndarray
    centers: np.ndarray


def line_search(
    fixed_a: float, fixed_b: float, alpha: np.ndarray, beta: np.ndarray, ell: np.ndarray
) -> np.ndarray:
    """Distance of each new centre from the mean of group A.

    Bisects the weight gamma of group A until both groups pay the same, for a fixed number of
    rounds, and returns the distances of the last weight tried.
    """
    gamma = step = FIRST_WEIGHT
    x = np.zeros_like(ell)
    for _ in range(LINE_SEARCH_ROUNDS):
        pull_a, pull_b = gamma * alpha, (1.0 - gamma) * beta
        weight = pull_a + pull_b
        x = np.divide(pull_b * ell, weight, out=np.zeros_like(ell), where=weight > 0)
        excess = (fixed_a + (alpha * x**2).sum()) - (fixed_b + (beta * (ell - x) ** 2).sum())
        if excess == 0:
            break
        step /= 2
        gamma += step if excess > 0 else -step
    return x


def finish_step(moments: MomentTable, centers: np.ndarray, points: DataFrame | PackedPoints) -> FairStep:
    """Turn the moments of a round into new centres.

    Centres far from their points, as a bad start may have them, cost a second pass over the points.
    """
    n_a, n_b = moments.n[CODE_A], moments.n[CODE_B]
    mean_a = _means(moments.sums[CODE_A], n_a)
    mean_b = _means(moments.sums[CODE_B], n_b)
    # A cluster without one group takes the other's mean; without both it stays where it is.
    has_a, has_b = (n_a > 0)[:, None], (n_b > 0)[:, None]
    mean_a, mean_b = (
        np.where(has_a, mean_a, np.where(has_b, mean_b, centers)),
        np.where(has_b, mean_b, np.where(has_a, mean_a, centers)),
    )
    share_a, share_b = max(1, n_a.sum()), max(1, n_b.sum())
    # Around its own mean a group costs less than around the old centre by n * |mean - centre|^2.
    costs = moments.cost[[CODE_A, CODE_B]]
    own = costs - np.stack([n_a * _row_squares(mean_a - centers), n_b * _row_squares(mean_b - centers)])
    if (own.sum(axis=1) < LEAST_SHARE * costs.sum(axis=1)).any():
        own = costs_around(points, centers, np.stack([mean_a, mean_b]))
    fixed_a, fixed_b = float(own[CODE_A].sum() / share_a), float(own[CODE_B].sum() / share_b)
    ell = np.sqrt(_row_squares(mean_a - mean_b))
    x = line_search(fixed_a, fixed_b, n_a / share_a, n_b / share_b, ell)
    toward_b = np.divide(x, ell, out=np.zeros_like(ell), where=ell > 0)[:, None]
    return FairStep(
        n_a, n_b, mean_a, mean_b, fixed_a, fixed_b, ell, x, (1.0 - toward_b) * mean_a + toward_b * mean_b
    )


def _means(sums: np.ndarray, n: np.ndarray) -> np.ndarray:
    return sums / np.maximum(n, 1)[:, None]


def _row_squares(rows: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", rows, rows)


def fair_step(points: DataFrame, centers: Centers) -> FairStep:
    """Run one round on ``(coords, grp)`` points from given centres."""
    matrix = center_matrix(centers)
    return finish_step(MomentTable.of(points, matrix).only_two_groups(), matrix, points)


def fair_moments(points: DataFrame, centers: Centers) -> DataFrame:
    """``(cluster, n_a, mean_a, n_b, mean_b)``, empty sides filled as the round fills them."""
    step = fair_step(points, centers)
    rows = [
        (i, int(step.n_a[i]), step.mean_a[i].tolist(), int(step.n_b[i]), step.mean_b[i].tolist())
        for i in range(len(step.ell))
    ]
    return points.sparkSession.createDataFrame(
        rows, "cluster int, n_a bigint, mean_a array<double>, n_b bigint, mean_b array<double>"
    )


def fair_fixed_costs(points: DataFrame, centers: Centers) -> DataFrame:
    """``(fixed_a, fixed_b)``: mean cost of each group around its own means."""
    step = fair_step(points, centers)
    return points.sparkSession.createDataFrame(
        [(step.fixed_a, step.fixed_b)], "fixed_a double, fixed_b double"
    )


def fair_line_search(points: DataFrame, centers: Centers) -> DataFrame:
    """``(cluster, x, ell)``: where on the segment between the group means each centre moves."""
    step = fair_step(points, centers)
    rows = [(i, float(x), float(ell)) for i, (x, ell) in enumerate(zip(step.x, step.ell))]
    return points.sparkSession.createDataFrame(rows, "cluster int, x double, ell double")


def fair_center_step(points: DataFrame, centers: Centers) -> DataFrame:
    """``(center_id, coords)`` after one round."""
    step = fair_step(points, centers)
    rows = [(i, c.tolist()) for i, c in enumerate(step.centers)]
    return points.sparkSession.createDataFrame(rows, "center_id int, coords array<double>")
