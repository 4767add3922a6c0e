"""Synthetic points: two groups with unlike spread around grid centres."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The shape of the mixture.
GROUP_A_SHARE = 0.3
GROUP_A_STD = 5.0
GROUP_B_STD = 15.0
GROUP_B_SHIFT = 15.0
CENTER_SPACING = 40.0
CENTER_JITTER = 10.0
DEFAULT_SEED = 123


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends on the values only, not on the partition layout."""
    mantissa = F.shiftrightunsigned(F.xxhash64(*parts), 11)
    return (mantissa.cast("double") + 0.5) / float(1 << 53)


def _normal(seed: int, row: Column, axis: int) -> Column:
    """A standard normal number by the Box-Muller transform."""
    radius = F.sqrt(-2.0 * F.log(_uniform(F.lit(seed), row, F.lit(f"radius{axis}"))))
    return radius * F.cos(2.0 * math.pi * _uniform(F.lit(seed), row, F.lit(f"angle{axis}")))


def even_split(rank: Column, total: int, parts: int) -> Column:
    """Part of the row with this rank when ``total`` rows split evenly, the remainder going to
    the first parts."""
    base, extra = divmod(total, parts)
    in_larger = extra * (base + 1)
    larger = F.floor(rank / (base + 1))
    return (
        F.when(rank < in_larger, larger)
        .otherwise(F.floor((rank - in_larger) / max(base, 1)) + extra)
        .cast("int")
    )


def mixture_points(
    spark: SparkSession,
    n: int,
    k: int,
    seed: int = DEFAULT_SEED,
    num_partitions: int | None = None,
    shuffle: bool = False,
) -> DataFrame:
    """``(point_id, coords, grp, cluster)``: 30 % A and 70 % B, spread evenly over k centres.

    Every value is a function of the seed and the row number, so partitions are generated
    independently and alike on any cluster. ``shuffle`` puts the rows in random order.
    """
    if k < 2 or n < k:
        raise ValueError("k must be at least 2 and n at least k")
    n_a = int(n * GROUP_A_SHARE)
    rows = spark.range(n, numPartitions=num_partitions) if num_partitions else spark.range(n)
    row = F.col("id")
    in_a = row < n_a
    grouped = rows.select(
        row.alias("point_id"),
        F.when(in_a, "A").otherwise("B").alias("grp"),
        F.when(in_a, even_split(row, n_a, k)).otherwise(even_split(row - n_a, n - n_a, k)).alias("cluster"),
    )
    side = math.isqrt(k - 1) + 1
    cluster, point = F.col("cluster"), F.col("point_id")
    places = (cluster % side, F.floor(cluster / side))
    std = F.when(F.col("grp") == "A", GROUP_A_STD).otherwise(GROUP_B_STD)
    shift = F.when(F.col("grp") == "A", 0.0).otherwise(GROUP_B_SHIFT)
    coords = [
        place * CENTER_SPACING
        + _uniform(F.lit(seed), cluster, F.lit(f"center{axis}")) * CENTER_JITTER
        + shift
        + _normal(seed, point, axis) * std
        for axis, place in enumerate(places)
    ]
    points = grouped.select("point_id", F.array(*coords).alias("coords"), "grp", "cluster")
    return points.orderBy(F.xxhash64(F.lit(seed), point)) if shuffle else points


def mixture_counts(points: DataFrame) -> DataFrame:
    """``(cluster, grp, n)`` of a generated mixture."""
    return points.groupBy("cluster", "grp").agg(F.count("*").alias("n"))
