"""Exact item frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def item_frequencies(items: DataFrame) -> DataFrame:
    """``(item, freq)``; map tasks count before the shuffle, so a hot item costs one row per task."""
    return items.groupBy("item").agg(F.count("*").alias("freq"))


def frequency_totals(freq: DataFrame) -> DataFrame:
    """``(processed, distinct_items)`` of a frequency table."""
    return freq.agg(
        F.coalesce(F.sum("freq"), F.lit(0)).alias("processed"), F.count("*").alias("distinct_items")
    )
