"""Whole reports: each answers one analyst's question with a few small tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from equipoise.functions.geometry import Centers, center_matrix
from equipoise.functions.hashing import SketchParams
from equipoise.operators.fair_step import finish_step
from equipoise.operators.heavy_hitters import heavy_hitter_errors, heavy_hitter_listing
from equipoise.operators.kmeans import DEFAULT_SEED, DEFAULT_TOL, initial_centers, standard_kmeans, standard_lloyd
from equipoise.operators.lloyd import largest_move, mean_centers
from equipoise.operators.moments import (
    CODE_A,
    CODE_B,
    MomentTable,
    PackedPoints,
    group_sizes,
    joint_costs,
    joint_moments,
    only_two_groups,
    packed,
)
from equipoise.operators.objectives import centers_frame
from equipoise.operators.sketches import pair_of
from equipoise.operators.wordcount import num_documents, word_count, word_statistics
from equipoise.streaming.bounded import count_min_of, count_of, frequencies_of


def word_report(documents: DataFrame, strategy: str = "direct") -> DataFrame:
    """``(num_docs, num_words, avg_len)`` of a document set."""
    statistics = word_statistics(word_count(documents, strategy))
    return statistics.select(num_documents(documents).scalar().alias("num_docs"), "num_words", "avg_len")


class GroupStatistics(NamedTuple):
    totals: DataFrame
    """``(n, na, nb, delta, phi)``"""
    clusters: DataFrame
    """``(center_id, coords, na, nb)``"""


def group_statistics(points: DataFrame | PackedPoints, centers: Centers) -> GroupStatistics:
    """Sizes, objectives and per-cluster group counts of given centres, from one pass over the points."""
    matrix = center_matrix(centers)
    moments = MomentTable.of(points, matrix)
    spark = (points.points if isinstance(points, PackedPoints) else points).sparkSession
    sizes = [int(n) for n in (moments.n.sum(), moments.n[CODE_A].sum(), moments.n[CODE_B].sum())]
    totals = spark.createDataFrame(
        [(*sizes, moments.delta, moments.phi)], "n bigint, na bigint, nb bigint, delta double, phi double"
    )
    clusters = spark.createDataFrame(
        [(i, c.tolist(), int(moments.n[CODE_A, i]), int(moments.n[CODE_B, i])) for i, c in enumerate(matrix)],
        "center_id int, coords array<double>, na bigint, nb bigint",
    )
    return GroupStatistics(totals, clusters)


def clustered_group_statistics(
    points: DataFrame, k: int, max_iter: int, seed: int = DEFAULT_SEED, start: Centers | None = None
) -> GroupStatistics:
    """``group_statistics`` of standard k-means centres, from a given start if there is one."""
    if start is None:
        return group_statistics(points, standard_kmeans(points, k, max_iter, seed))
    with packed(points) as blocks:
        return group_statistics(blocks, standard_lloyd(blocks, start, max_iter, tol=0.0))


class TrainedComparison(NamedTuple):
    report: DataFrame
    """``(method, fair_objective)``"""
    centers: dict[str, DataFrame]
    """``(center_id, coords)`` of each method"""


def compare_training(
    points: DataFrame | PackedPoints,
    k: int,
    max_iter: int,
    seed: int = DEFAULT_SEED,
    start: Centers | None = None,
    tol: float = DEFAULT_TOL,
) -> TrainedComparison:
    """Standard and fair k-means from one start, trained side by side.

    A round reads the persisted blocks once and advances both sets of centres; standard rounds end
    when no centre moves farther than ``tol``. A last pass costs both. If a group has no points,
    the standard centres answer for both.
    """
    if not isinstance(points, PackedPoints):
        with packed(points) as blocks:
            return compare_training(blocks, k, max_iter, seed, start, tol)
    spark = points.points.sparkSession
    sizes = only_two_groups(group_sizes(points))
    first = center_matrix(initial_centers(points.points, k, seed) if start is None else start)
    fair_too = bool(sizes[CODE_A] and sizes[CODE_B])
    found, moving = {"standard": first, "fair": first}, ["standard", *["fair"] * fair_too]
    for _ in range(max_iter):
        if not moving:
            break
        tables = dict(zip(moving, joint_moments(points, [found[m] for m in moving])))
        old = found["standard"]
        if "standard" in tables:
            found["standard"] = mean_centers(tables["standard"], old)
            if largest_move(old, found["standard"]) <= tol:
                moving.remove("standard")
        if "fair" in tables:
            found["fair"] = finish_step(tables["fair"], found["fair"], points).centers
    if not fair_too:
        found["fair"] = found["standard"]
    costs = joint_costs(points, list(found.values()))
    rows = [(method, cost.phi) for method, cost in zip(found, costs)]
    report = spark.createDataFrame(rows, "method string, fair_objective double")
    return TrainedComparison(report, {method: centers_frame(spark, m) for method, m in found.items()})


def fair_vs_standard(
    points: DataFrame, k: int, max_iter: int, seed: int = DEFAULT_SEED, start: Centers | None = None, tol: float = DEFAULT_TOL
) -> DataFrame:
    """``(method, fair_objective)`` for standard and for fair k-means; see ``compare_training``."""
    return compare_training(points, k, max_iter, seed, start, tol).report


class StreamReport(NamedTuple):
    errors: DataFrame
    """``(processed, distinct_items, hh, cm_err, cs_err)``"""
    listing: DataFrame
    """``(item, freq, cm_est)``"""


def stream_report(
    counters: DataFrame, k: int, count_min: SketchParams, count: SketchParams, max_listed: int | None = None
) -> StreamReport:
    """Heavy hitters and sketch errors from the counters that a stream left behind."""
    freq = frequencies_of(counters)
    cm_table = count_min_of(counters)
    pair = pair_of(cm_table, count_of(counters), count_min, count)
    return StreamReport(
        heavy_hitter_errors(freq, k, count_min, count, pair),
        heavy_hitter_listing(freq, cm_table, count_min, k, max_listed),
    )
