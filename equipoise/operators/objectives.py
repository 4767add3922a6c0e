"""How well given centres serve a population of two groups, A and B."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equipoise.functions.geometry import Centers, center_matrix
from equipoise.operators.assignment import assign, uses_literals

GROUP_A = "A"
GROUP_B = "B"


def is_a(group_col: str = "grp") -> Column:
    return F.col(group_col) == GROUP_A


def is_b(group_col: str = "grp") -> Column:
    return F.col(group_col) == GROUP_B


def group_counts(points: DataFrame, group_col: str = "grp") -> DataFrame:
    """``(n, na, nb)`` in one pass; points with another label count in ``n`` only."""
    return points.agg(
        F.count("*").alias("n"),
        F.count_if(is_a(group_col)).alias("na"),
        F.count_if(is_b(group_col)).alias("nb"),
    )


def standard_objective(points: DataFrame, centers: Centers) -> DataFrame:
    """Mean squared distance to the nearest centre, over all points whatever their label."""
    return assign(points.select("coords"), centers).agg(F.avg("sq_dist").alias("delta"))


def _group_mean(sq_dist: Column, member: Column) -> Column:
    # A group without members contributes nothing.
    return F.coalesce(F.avg(F.when(member, sq_dist)), F.lit(0.0))


def fair_objective(points: DataFrame, centers: Centers) -> DataFrame:
    """``(mean_a, mean_b, phi)``: the mean cost of each group and the larger of the two."""
    means = assign(points.select("coords", "grp"), centers).agg(
        _group_mean(F.col("sq_dist"), is_a()).alias("mean_a"),
        _group_mean(F.col("sq_dist"), is_b()).alias("mean_b"),
    )
    return means.withColumn("phi", F.greatest("mean_a", "mean_b"))


def compare_objectives(points: DataFrame, methods: Mapping[str, Centers]) -> DataFrame:
    """``(method, fair_objective)`` for several sets of centres, all in one pass over the points."""
    costed = points.select("coords", "grp")
    matrices = [center_matrix(centers) for centers in methods.values()]
    literals = uses_literals(*matrices)
    means = []
    for i, matrix in enumerate(matrices):
        costed = assign(
            costed, matrix, cluster_col=f"_cluster{i}", sq_dist_col=f"_cost{i}", literals=literals
        )
        means.append(
            F.greatest(_group_mean(F.col(f"_cost{i}"), is_a()), _group_mean(F.col(f"_cost{i}"), is_b()))
        )
    row = costed.agg(*[m.alias(f"_phi{i}") for i, m in enumerate(means)])
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("method"), F.col(f"_phi{i}").alias("fair_objective"))
            for i, name in enumerate(methods)
        ]
    )
    return row.select(F.explode(pairs).alias("pair")).select("pair.method", "pair.fair_objective")


def centers_frame(spark: SparkSession, centers: Centers) -> DataFrame:
    """``(center_id, coords)``, one row per centre."""
    matrix = center_matrix(centers)
    rows = [(i, [float(v) for v in c]) for i, c in enumerate(matrix)]
    return spark.createDataFrame(rows, "center_id int, coords array<double>")


def _fill_clusters(counts: DataFrame, centers: Centers) -> DataFrame:
    """One row per centre, with zero counts where no point chose it."""
    matrix = center_matrix(centers)
    spark = counts.sparkSession
    ids = spark.range(len(matrix), numPartitions=1).select(F.col("id").cast("int").alias("cluster"))
    return ids.join(counts, "cluster", "left").na.fill(0, ["na", "nb"])


def cluster_group_counts(points: DataFrame, centers: Centers) -> DataFrame:
    """``(cluster, na, nb)`` for every centre, empty ones included."""
    counts = (
        assign(points.select("coords", "grp"), centers)
        .groupBy("cluster")
        .agg(F.count_if(is_a()).alias("na"), F.count_if(is_b()).alias("nb"))
    )
    return _fill_clusters(counts, centers)


def cluster_group_counts_salted(
    points: DataFrame, centers: Centers, num_salts: int = 16, salt_from: str | None = None
) -> DataFrame:
    """``cluster_group_counts`` in two rounds: per (salt, cluster), then per cluster.

    The salt hashes ``salt_from`` (a row identifier) or else the point itself, so a retried
    task salts the same way.
    """
    if num_salts < 1:
        raise ValueError("num_salts must be at least 1")
    source = [F.col(salt_from)] if salt_from else [F.col("coords"), F.col("grp")]
    salt = F.pmod(F.xxhash64(*source), F.lit(num_salts)).alias("salt")
    counts = (
        assign(points.select("coords", "grp", salt), centers)
        .groupBy("salt", "cluster")
        .agg(F.count_if(is_a()).alias("na"), F.count_if(is_b()).alias("nb"))
        .groupBy("cluster")
        .agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    )
    return _fill_clusters(counts, centers)
