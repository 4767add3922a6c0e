"""The query catalogue: every operator as a query over the test tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equipoise.functions.geometry import center_matrix
from equipoise.operators import fair_step as fair
from equipoise.operators import heavy_hitters as hh
from equipoise.operators import objectives as obj
from equipoise.operators import wordcount as wc
from equipoise.operators.assignment import assign
from equipoise.operators.frequencies import frequency_totals, item_frequencies
from equipoise.operators.kmeans import fair_kmeans, sampled_centers, standard_lloyd
from equipoise.operators.prefix import ordered_prefix
from equipoise.operators.series import series_sample, series_summary
from equipoise.operators.sketches import (
    count_min_sketch,
    count_sketch,
    with_count_min_estimate,
    with_count_sketch_estimate,
)
from equipoise.plans import reports, views
from equipoise.session import shared_dir
from equipoise.sources.sinks import clustered_point_lines
from equipoise.sources.text import parse_clustered_points, parse_items, parse_points
from equipoise.streaming.bounded import count_prefix, frequencies_of
from equipoise.streaming.counters import latest_counters, running_counters, start_counters

Query = Callable[[SparkSession, str], DataFrame]

CENTERS = views.CENTERS
CM, CS, CS_EVEN = views.COUNT_MIN_PARAMS, views.COUNT_PARAMS, views.EVEN_COUNT_PARAMS
CM_LARGE, CS_LARGE = views.LARGE_COUNT_MIN_PARAMS, views.LARGE_COUNT_PARAMS
ROUND_DIGITS = 6
FAIR_ROUNDS = 3
TRAINED_CLUSTERS = 4
TRAINING_ROUNDS = 5


def _round(name: str, col: Column | str | None = None) -> Column:
    return F.round(name if col is None else col, ROUND_DIGITS).alias(name)


def _center_columns(centers: DataFrame, *more: str) -> DataFrame:
    return centers.select(
        F.col("center_id").alias("cluster"),
        _round("cx", F.col("coords")[0]),
        _round("cy", F.col("coords")[1]),
        *more,
    )


# Words


def _word_counts(strategy: str) -> Query:
    return lambda spark, sf: wc.word_count(views.documents(spark, sf), strategy)


def _num_docs(spark: SparkSession, sf: str) -> DataFrame:
    return wc.num_documents(views.table(spark, sf, "documents", "doc_id"))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return wc.word_count(wc.documents_by_line(views.documents(spark, sf)))


def _num_lines(spark: SparkSession, sf: str) -> DataFrame:
    return wc.num_documents(wc.documents_by_line(views.documents(spark, sf)))


def _distinct_words(spark: SparkSession, sf: str) -> DataFrame:
    return wc.distinct_words(wc.word_count(views.documents(spark, sf)))


def _avg_word_length(spark: SparkSession, sf: str) -> DataFrame:
    return wc.mean_word_length(wc.word_count(views.documents(spark, sf))).select(_round("avg_len"))


def _word_report(spark: SparkSession, sf: str) -> DataFrame:
    report = reports.word_report(views.documents(spark, sf))
    return report.select("num_docs", "num_words", _round("avg_len"))


# Points


def _point_lines(spark: SparkSession, sf: str, cluster: Column | None = None) -> DataFrame:
    """``(point_id, value)``: the points as the text lines the parsers read."""
    columns = [F.format_string("%.6f", "x"), F.format_string("%.6f", "y"), F.col("grp")]
    if cluster is not None:
        columns.append(cluster)
    points = views.points_xy(spark, sf)
    return points.select("point_id", F.concat_ws(",", *columns).alias("value"))


def _parsed(points: DataFrame) -> DataFrame:
    return points.select(
        "point_id", _round("x", F.col("coords")[0]), _round("y", F.col("coords")[1]), "grp"
    )


def _parse_strict(spark: SparkSession, sf: str) -> DataFrame:
    # Every third line is followed by empty tokens, which do not count.
    lines = _point_lines(spark, sf).withColumn(
        "value", F.when(F.col("point_id") % 3 == 0, F.concat("value", F.lit(",,"))).otherwise(F.col("value"))
    )
    return _parsed(parse_points(lines))


def _parse_cluster_id(spark: SparkSession, sf: str) -> DataFrame:
    # Null is skipped by concat_ws, so half of the lines end with the group.
    cluster = F.when(F.col("point_id") % 2 == 0, (F.col("point_id") % 7).cast("string"))
    return _parsed(parse_points(_point_lines(spark, sf, cluster), has_cluster_id="auto"))


def _parse_tolerant(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("point_id") % 4
    cluster = (
        F.when(kind == 0, "1").when(kind == 1, "12").when(kind == 2, "none").otherwise("7.5")
    )
    lines = _point_lines(spark, sf, cluster)
    broken = F.when(F.col("point_id") % 11 == 0, F.concat(F.lit("x"), F.col("value"))).otherwise(F.col("value"))
    parsed = parse_clustered_points(lines.withColumn("value", broken))
    return parsed.select("point_id", _round("x", F.col("x")), _round("y", F.col("y")), "grp", "cluster", "reason")


def _group_counts(spark: SparkSession, sf: str) -> DataFrame:
    return obj.group_counts(views.points(spark, sf, keep_foreign=True))


def _nearest_center(spark: SparkSession, sf: str) -> DataFrame:
    points = assign(views.points(spark, sf), CENTERS)
    return points.select("point_id", "cluster", _round("dist", F.col("sq_dist")))


def _nearest_center_wide(spark: SparkSession, sf: str) -> DataFrame:
    centers = views.label_centers(spark, sf)
    points = assign(views.embedding_points(spark, sf), centers)
    return points.select("point_id", "cluster", _round("dist", F.col("sq_dist")))


def _standard_objective(spark: SparkSession, sf: str) -> DataFrame:
    # Foreign labels count here as they do in the population.
    return obj.standard_objective(views.points(spark, sf, keep_foreign=True), CENTERS).select(_round("delta"))


def _fair_objective(spark: SparkSession, sf: str) -> DataFrame:
    means = obj.fair_objective(views.points(spark, sf), CENTERS)
    return means.select(_round("mean_a"), _round("mean_b"), _round("phi"))


def _fair_objective_wide(spark: SparkSession, sf: str) -> DataFrame:
    means = obj.fair_objective(views.embedding_points(spark, sf), views.label_centers(spark, sf))
    return means.select(_round("mean_a"), _round("mean_b"), _round("phi"))


def _compare_objectives(spark: SparkSession, sf: str) -> DataFrame:
    compared = obj.compare_objectives(
        views.points(spark, sf), {"first": CENTERS, "second": views.OTHER_CENTERS}
    )
    return compared.select("method", _round("fair_objective"))


def _cluster_group_counts(spark: SparkSession, sf: str) -> DataFrame:
    return obj.cluster_group_counts(views.points(spark, sf), CENTERS)


def _cluster_group_counts_salted(spark: SparkSession, sf: str) -> DataFrame:
    return obj.cluster_group_counts_salted(views.points(spark, sf), CENTERS, salt_from=None)


def _group_statistics(spark: SparkSession, sf: str) -> DataFrame:
    totals = reports.group_statistics(views.points(spark, sf, keep_foreign=True), CENTERS).totals
    return totals.select("n", "na", "nb", _round("delta"), _round("phi"))


def _cluster_report(spark: SparkSession, sf: str) -> DataFrame:
    clusters = reports.group_statistics(views.points(spark, sf, keep_foreign=True), CENTERS).clusters
    return _center_columns(clusters, "na", "nb")


def _cluster_moments(spark: SparkSession, sf: str) -> DataFrame:
    moments = fair.fair_moments(views.points(spark, sf), CENTERS)
    return moments.select(
        "cluster",
        "n_a",
        _round("mx_a", F.col("mean_a")[0]),
        _round("my_a", F.col("mean_a")[1]),
        "n_b",
        _round("mx_b", F.col("mean_b")[0]),
        _round("my_b", F.col("mean_b")[1]),
    )


def _fair_fixed_costs(spark: SparkSession, sf: str) -> DataFrame:
    costs = fair.fair_fixed_costs(views.points(spark, sf), CENTERS)
    return costs.select(_round("fixed_a"), _round("fixed_b"))


def _fair_line_search(spark: SparkSession, sf: str) -> DataFrame:
    return fair.fair_line_search(views.points(spark, sf), CENTERS).select("cluster", _round("x"), _round("ell"))


def _fair_center_step(spark: SparkSession, sf: str) -> DataFrame:
    return _center_columns(fair.fair_center_step(views.points(spark, sf), CENTERS))


def _fair_lloyd(spark: SparkSession, sf: str) -> DataFrame:
    centers = fair_kmeans(views.points(spark, sf), len(CENTERS), FAIR_ROUNDS, start=CENTERS)
    return _center_columns(centers)


def _start(spark: SparkSession, sf: str) -> np.ndarray:
    """A start that SQL can recompute: it depends on the rows alone."""
    found = sampled_centers(views.points(spark, sf), TRAINED_CLUSTERS, key=views.start_key())
    return center_matrix(found)


def _fair_kmeans(spark: SparkSession, sf: str) -> DataFrame:
    points, start = views.points(spark, sf), _start(spark, sf)
    return _center_columns(fair_kmeans(points, len(start), TRAINING_ROUNDS, start=start))


def _standard_kmeans(spark: SparkSession, sf: str) -> DataFrame:
    return _center_columns(standard_lloyd(views.points(spark, sf), _start(spark, sf), TRAINING_ROUNDS, tol=0.0))


def _initial_centers(spark: SparkSession, sf: str) -> DataFrame:
    return _center_columns(sampled_centers(views.points(spark, sf), TRAINED_CLUSTERS, key=views.start_key()))


def _standard_lloyd(spark: SparkSession, sf: str) -> DataFrame:
    return _center_columns(standard_lloyd(views.points(spark, sf), CENTERS, FAIR_ROUNDS, tol=0.0))


def _fair_vs_standard(spark: SparkSession, sf: str) -> DataFrame:
    report = reports.fair_vs_standard(views.points(spark, sf), len(CENTERS), FAIR_ROUNDS, start=CENTERS, tol=0.0)
    return report.select("method", _round("fair_objective"))


def _clustered_group_statistics(spark: SparkSession, sf: str) -> DataFrame:
    points, start = views.points(spark, sf, keep_foreign=True), _start(spark, sf)
    totals, clusters = reports.clustered_group_statistics(points, len(start), TRAINING_ROUNDS, start=start)
    whole = [totals.select(F.col(c)).scalar().alias(f"tot_{c}") for c in ("n", "na", "nb")]
    objectives = [_round(c, totals.select(c).scalar()) for c in ("delta", "phi")]
    return _center_columns(clusters, "na", "nb", *whole, *objectives)


def _fair_step_lone_groups(spark: SparkSession, sf: str) -> DataFrame:
    step = fair.fair_center_step(views.points(spark, sf), views.LONE_CENTERS)
    return _center_columns(step)


def _fair_moments_lone_groups(spark: SparkSession, sf: str) -> DataFrame:
    moments = fair.fair_moments(views.points(spark, sf), views.LONE_CENTERS)
    means = [_round(f"m{axis}_{g}", F.col(f"mean_{g}")[j]) for g in "ab" for j, axis in enumerate("xy")]
    return moments.select("cluster", "n_a", "n_b", *means)


def _fair_fixed_costs_shifted(spark: SparkSession, sf: str) -> DataFrame:
    costs = fair.fair_fixed_costs(views.shifted_points(spark, sf), CENTERS)
    return costs.select(_round("fixed_a"), _round("fixed_b"))


def _save_points(spark: SparkSession, sf: str) -> DataFrame:
    return clustered_point_lines(views.points(spark, sf), CENTERS, dims=2)


def _cluster_series(spark: SparkSession, sf: str) -> DataFrame:
    clustered = assign(views.points(spark, sf), CENTERS)
    summary = series_summary(
        clustered.select(F.col("coords")[0].alias("x"), F.col("coords")[1].alias("y"), "grp", "cluster")
    )
    bounds = [_round(c) for c in ("min_x", "max_x", "min_y", "max_y")]
    return summary.select("series", "n", *bounds)


def _cluster_series_sample(spark: SparkSession, sf: str) -> DataFrame:
    clustered = assign(views.points(spark, sf), CENTERS).select(
        "point_id", F.col("coords")[0].alias("x"), F.col("coords")[1].alias("y"), "grp", "cluster"
    )
    sample = series_sample(clustered, views.SAMPLE_ROWS, key=views.start_key())
    return sample.select("series", _round("x"), _round("y"))


# Items


def _freq(spark: SparkSession, sf: str) -> DataFrame:
    return item_frequencies(views.items(spark, sf))


def _half(spark: SparkSession, sf: str) -> int:
    """The prefix length of the catalogue: half of the stream."""
    return max(1, views.items(spark, sf).count() // 2)


def _parse_items(spark: SparkSession, sf: str) -> DataFrame:
    lines = views.items(spark, sf).select("seq", F.col("item").cast("string").alias("value"))
    return parse_items(lines)


def _item_totals(spark: SparkSession, sf: str) -> DataFrame:
    return frequency_totals(_freq(spark, sf))


def _items_prefix(spark: SparkSession, sf: str) -> DataFrame:
    prefix = ordered_prefix(views.items(spark, sf), _half(spark, sf), "seq")
    return item_frequencies(prefix)


def _count_min_sketch(spark: SparkSession, sf: str) -> DataFrame:
    return count_min_sketch(views.items(spark, sf), CM)


def _count_sketch(spark: SparkSession, sf: str) -> DataFrame:
    return count_sketch(views.items(spark, sf), CS)


def _count_min_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return with_count_min_estimate(_freq(spark, sf), _count_min_sketch(spark, sf), CM)


def _count_sketch_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return with_count_sketch_estimate(_freq(spark, sf), _count_sketch(spark, sf), CS)


def _count_sketch_estimate_even(spark: SparkSession, sf: str) -> DataFrame:
    sketch = count_sketch(views.items(spark, sf), CS_EVEN)
    return with_count_sketch_estimate(_freq(spark, sf), sketch, CS_EVEN)


def _count_min_estimate_large(spark: SparkSession, sf: str) -> DataFrame:
    # Every event asks for its item, so items repeat.
    items = views.items(spark, sf)
    return with_count_min_estimate(items, count_min_sketch(items, CM_LARGE), CM_LARGE)


def _count_sketch_estimate_large(spark: SparkSession, sf: str) -> DataFrame:
    items = views.items(spark, sf)
    return with_count_sketch_estimate(items, count_sketch(items, CS_LARGE), CS_LARGE)


def _heavy_hitters(spark: SparkSession, sf: str) -> DataFrame:
    return hh.heavy_hitters(_freq(spark, sf), views.TOP_K)


def _heavy_hitter_listing(spark: SparkSession, sf: str) -> DataFrame:
    freq = _freq(spark, sf)
    return hh.heavy_hitter_listing(freq, count_min_sketch(freq, CM, weight="freq"), CM, views.TOP_K)


def _heavy_hitter_errors(spark: SparkSession, sf: str) -> DataFrame:
    errors = hh.heavy_hitter_errors(_freq(spark, sf), views.TOP_K, CM, CS)
    return errors.select("processed", "distinct_items", "hh", _round("cm_err"), _round("cs_err"))


# Streams


def _run_counters(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared_dir(spark, "counters")
    counters = running_counters(views.item_replay(spark, sf, f"{folder}/items"), CM, CS)
    # Snapshots are taken on the way, as a long stream takes them.
    start_counters(counters, f"{folder}/out", f"{folder}/checkpoint", snapshot_every=2).awaitTermination()
    return latest_counters(spark, f"{folder}/out")


def _stream_item_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return frequencies_of(_run_counters(spark, sf))


def _stream_sketches(spark: SparkSession, sf: str) -> DataFrame:
    counters = _run_counters(spark, sf).where(F.col("kind") != "exact")
    return counters.select("kind", "d", F.col("key").alias("col"), "counter")


def _run_prefix(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared_dir(spark, "prefix")
    return count_prefix(
        views.item_replay(spark, sf, f"{folder}/items"),
        _half(spark, sf),
        CM,
        CS,
        f"{folder}/out",
        f"{folder}/checkpoint",
        trigger={"availableNow": True},
        order_by="seq",
    )


def _stream_prefix_counters(spark: SparkSession, sf: str) -> DataFrame:
    return _run_prefix(spark, sf)


def _stream_report(spark: SparkSession, sf: str) -> DataFrame:
    errors = reports.stream_report(_run_prefix(spark, sf), views.TOP_K, CM, CS).errors
    return errors.select("processed", "distinct_items", "hh", _round("cm_err"), _round("cs_err"))


QUERIES: dict[str, Query] = {
    "wc_num_docs": _num_docs,
    "wc_direct": _word_counts("direct"),
    "wc_salted": _word_counts("salted"),
    "wc_partition": _word_counts("partition"),
    "wc_by_line": _lines,
    "wc_num_lines": _num_lines,
    "wc_distinct_words": _distinct_words,
    "wc_avg_word_length": _avg_word_length,
    "wc_report": _word_report,
    "points_parse_strict": _parse_strict,
    "points_parse_cluster_id": _parse_cluster_id,
    "points_parse_tolerant": _parse_tolerant,
    "group_counts": _group_counts,
    "nearest_center": _nearest_center,
    "nearest_center_wide": _nearest_center_wide,
    "standard_objective": _standard_objective,
    "fair_objective": _fair_objective,
    "fair_objective_wide": _fair_objective_wide,
    "compare_objectives": _compare_objectives,
    "cluster_group_counts": _cluster_group_counts,
    "cluster_group_counts_salted": _cluster_group_counts_salted,
    "group_statistics": _group_statistics,
    "cluster_report": _cluster_report,
    "cluster_moments": _cluster_moments,
    "fair_fixed_costs": _fair_fixed_costs,
    "fair_line_search": _fair_line_search,
    "fair_center_step": _fair_center_step,
    "fair_lloyd": _fair_lloyd,
    "fair_kmeans": _fair_kmeans,
    "standard_kmeans": _standard_kmeans,
    "initial_centers": _initial_centers,
    "standard_lloyd": _standard_lloyd,
    "fair_vs_standard": _fair_vs_standard,
    "clustered_group_statistics": _clustered_group_statistics,
    "fair_step_lone_groups": _fair_step_lone_groups,
    "fair_moments_lone_groups": _fair_moments_lone_groups,
    "fair_fixed_costs_shifted": _fair_fixed_costs_shifted,
    "save_points": _save_points,
    "cluster_series": _cluster_series,
    "cluster_series_sample": _cluster_series_sample,
    "items_parse": _parse_items,
    "item_frequencies": _freq,
    "item_totals": _item_totals,
    "items_prefix": _items_prefix,
    "count_min_sketch": _count_min_sketch,
    "count_sketch": _count_sketch,
    "count_min_estimate": _count_min_estimate,
    "count_sketch_estimate": _count_sketch_estimate,
    "count_sketch_estimate_even": _count_sketch_estimate_even,
    "count_min_estimate_large": _count_min_estimate_large,
    "count_sketch_estimate_large": _count_sketch_estimate_large,
    "heavy_hitters": _heavy_hitters,
    "heavy_hitter_listing": _heavy_hitter_listing,
    "heavy_hitter_errors": _heavy_hitter_errors,
    "stream_item_frequencies": _stream_item_frequencies,
    "stream_sketches": _stream_sketches,
    "stream_prefix_counters": _stream_prefix_counters,
    "stream_report": _stream_report,
}
