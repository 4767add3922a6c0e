"""Top-K heavy hitters with ties, and how well the sketches estimate them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equipoise.functions.hashing import SketchParams
from equipoise.operators.frequencies import frequency_totals
from equipoise.operators.sketches import sketch_pair, with_both_estimates, with_count_min_estimate

# Up to this many values each task keeps its own top K and one task merges them all.
_TOP_VALUES = 1_000


def kth_frequency(freq: DataFrame, k: int) -> DataFrame:
    """``(phi)``: the k-th largest frequency, or 0 when there are fewer than k items."""
    if k < 1:
        raise ValueError("k must be at least 1")
    if k <= _TOP_VALUES:
        top = freq.select("freq").orderBy(F.desc("freq")).limit(k)
        return top.agg(F.when(F.count("*") < k, 0).otherwise(F.min("freq")).cast("bigint").alias("phi"))
    # Distinct frequencies of N items are fewer than sqrt(2 N), so ranking them fits one task.
    histogram = freq.groupBy("freq").agg(F.count("*").alias("n"))
    at_least = F.sum("n").over(Window.orderBy(F.desc("freq")))
    reached = histogram.withColumn("at_least", at_least).where(F.col("at_least") >= k)
    return reached.agg(F.coalesce(F.max("freq"), F.lit(0)).alias("phi"))


def heavy_hitters(freq: DataFrame, k: int) -> DataFrame:
    """``(item, freq)`` of every item at least as frequent as the k-th; ties can make them more than k.

    The threshold is a scalar subquery over the same aggregate, whose shuffle Spark reuses.
    """
    return freq.where(F.col("freq") >= kth_frequency(freq, k).scalar())


def heavy_hitter_listing(
    freq: DataFrame, sketch: DataFrame, params: SketchParams, k: int, max_listed: int | None = None
) -> DataFrame:
    """``(item, freq, cm_est)`` of the k heavy hitters with the smallest ids, in id order.

    ``max_listed`` rows at most, if given.
    """
    listed = heavy_hitters(freq, k).orderBy("item").limit(k if max_listed is None else min(k, max_listed))
    return with_count_min_estimate(listed, sketch, params, "cm_est").orderBy("item")


def _relative_error(estimate: str) -> Column:
    return F.avg(F.abs(F.col("freq") - F.col(estimate)) / F.col("freq"))


def heavy_hitter_errors(
    freq: DataFrame,
    k: int,
    count_min: SketchParams,
    count: SketchParams,
    pair: DataFrame | None = None,
) -> DataFrame:
    """``(processed, distinct_items, hh, cm_err, cs_err)``: one row, errors null without items.

    Without a ``sketch_pair`` it is built from the frequency table, which is the same by
    linearity and hashes every distinct item once.
    """
    if pair is None:
        pair = sketch_pair(freq, count_min, count, weight="freq")
    errors = with_both_estimates(heavy_hitters(freq, k), pair, count_min, count).agg(
        F.count("*").alias("hh"),
        _relative_error("cm_est").alias("cm_err"),
        _relative_error("cs_est").alias("cs_err"),
    )
    totals = frequency_totals(freq)
    return errors.select(
        totals.select("processed").scalar().alias("processed"),
        totals.select("distinct_items").scalar().alias("distinct_items"),
        "hh",
        "cm_err",
        "cs_err",
    )
