"""Points as labelled series, the data behind a scatter plot by cluster and group."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Parts of a series that are reduced apart before they meet.
_PARTS = 16


def series_key() -> Column:
    return F.concat_ws("-", F.col("cluster").cast("string"), F.col("grp")).alias("series")


def series_points(points: DataFrame) -> DataFrame:
    """``(series, x, y)`` of every clustered point ``(x, y, grp, cluster)``."""
    return points.select(series_key(), "x", "y")


def series_summary(points: DataFrame) -> DataFrame:
    """``(series, n, min_x, max_x, min_y, max_y)``: size and bounds of each series."""
    return series_points(points).groupBy("series").agg(
        F.count("*").alias("n"),
        F.min("x").alias("min_x"),
        F.max("x").alias("max_x"),
        F.min("y").alias("min_y"),
        F.max("y").alias("max_y"),
    )


def series_sample(points: DataFrame, k: int, seed: int = 0, key: Column | None = None) -> DataFrame:
    """``(series, x, y)``: at most ``k`` points of each series, for a client to draw.

    Those of the smallest hashes are taken, so the sample depends neither on order nor on
    partitions. A task keeps ``k`` points of each series and passes on no others; what tasks kept is
    reduced in parts of a series and then as a whole, so a series that holds most of the points is
    never in one place. ``key`` replaces the hash of the row by another bigint; equal keys are
    ordered by ``x`` and ``y``.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    hashed = F.xxhash64(F.lit(seed), "x", "y", "grp", "cluster") if key is None else key
    rows = points.select(series_key(), hashed.cast("bigint").alias("key"), "x", "y")

    def smallest(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame])
            held = frame.sort_values(["series", "key", "x", "y"]).groupby("series", dropna=False).head(k)
        if held is not None:
            yield held

    kept = rows.mapInPandas(smallest, rows.schema)
    parts = kept.repartition("series", F.pmod("key", F.lit(_PARTS))).mapInPandas(smallest, rows.schema)
    return parts.repartition("series").mapInPandas(smallest, rows.schema).select("series", "x", "y")
