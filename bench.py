"""Times the headline queries and the published clustering run; prints one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local cores).
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equipoise.functions.geometry import center_matrix
from equipoise.operators.kmeans import fair_kmeans, sampled_centers, standard_lloyd
from equipoise.operators.moments import joint_costs, packed
from equipoise.plans.catalog import QUERIES
from equipoise.session import local_session, shared_dir
from equipoise.sources.text import parse_points, read_lines

HEADLINE = (
    "wc_direct",
    "wc_salted",
    "wc_partition",
    "wc_report",
    "points_parse_strict",
    "nearest_center",
    "nearest_center_wide",
    "fair_objective",
    "cluster_group_counts",
    "group_statistics",
    "fair_center_step",
    "fair_lloyd",
    "standard_kmeans",
    "fair_kmeans",
    "items_prefix",
    "count_min_sketch",
    "count_sketch",
    "count_min_estimate",
    "heavy_hitters",
    "heavy_hitter_errors",
    "cluster_series_sample",
    "fair_vs_standard",
    "stream_item_frequencies",
    "stream_prefix_counters",
)

TABLES, TABLE_FILES = ("documents", "orders", "embeddings", "events"), 8

# The published run: 1,000,000 points of group A and 100,000 of group B, K=100, M=10, L=16.
RUN_A, RUN_B, RUN_DIM, RUN_K, RUN_M, RUN_SPLITS = 1_000_000, 100_000, 7, 100, 10, 16
PUBLISHED_SECONDS = {
    "standard_centers": 2.469,
    "fair_centers": 4.877,
    "objective_standard": 0.125,
    "objective_fair": 0.124,
}


def run(frame: DataFrame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def timed(action: Callable[[], object]) -> tuple[float, object]:
    start = time.perf_counter()
    result = action()
    return time.perf_counter() - start, result


def best_of(repeats: int, action: Callable[[], object]) -> tuple[float, object]:
    return min((timed(action) for _ in range(repeats)), key=lambda r: r[0])


def published_lines(spark: SparkSession) -> str:
    """Text lines of the published run's size; its own input is not public. Clumps of group B lie
    apart from those of A, so a centre that is fair differs from one that is not."""
    blob, is_a = F.col("id") % 60, F.col("id") < RUN_A
    coords = [
        F.pmod(F.xxhash64(blob, F.lit(j)), F.lit(1000)) / 10.0
        + F.when(is_a, 0.0).otherwise(40.0)
        + F.randn(j) * F.when(is_a, 3.0).otherwise(8.0)
        for j in range(RUN_DIM)
    ]
    line = F.concat_ws(",", *[F.round(c, 4).cast("string") for c in coords], F.when(is_a, "A").otherwise("B"))
    path = shared_dir(spark, "published")
    spark.range(RUN_A + RUN_B).select(line.alias("value")).write.text(path)
    return path


def published_run(spark: SparkSession) -> tuple[dict[str, float], dict[str, float]]:
    """Each step once. As in the published run, the standard centres pay for parsing and for filling
    the cache; both methods find their start themselves."""
    path = published_lines(spark)
    seconds: dict[str, float] = {}
    values: dict[str, float] = {}
    began = time.perf_counter()
    points = parse_points(read_lines(spark, path, RUN_SPLITS))
    with packed(points) as blocks:

        def trained(fit: Callable[[np.ndarray], DataFrame]) -> np.ndarray:
            return center_matrix(fit(center_matrix(sampled_centers(blocks, RUN_K))))

        standard = trained(lambda start: standard_lloyd(blocks, start, RUN_M))
        seconds["standard_centers"] = time.perf_counter() - began
        seconds["fair_centers"], fair = timed(
            lambda: trained(lambda start: fair_kmeans(blocks, len(start), RUN_M, start=start))
        )
        for name, centers in (("standard", standard), ("fair", fair)):
            seconds[f"objective_{name}"], costs = timed(lambda: joint_costs(blocks, [centers])[0])
            values[f"fair_objective_{name}"] = round(costs.phi, 4)
    return seconds, values


def in_several_files(spark: SparkSession, sf_dir: str) -> str:
    """The tables that the queries read, each dealt to a few files as large tables are."""
    folder = shared_dir(spark, "tables")
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(TABLE_FILES).write.parquet(f"{folder}/{name}.parquet")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = local_session(cpus, "equipoise-bench")
    tables = in_several_files(spark, sf_dir)
    queries = {}
    # Warm up compilation and worker processes before anything is timed.
    for name in HEADLINE:
        run(QUERIES[name](spark, tables))
    for name in HEADLINE:
        seconds, _ = best_of(2, lambda: run(QUERIES[name](spark, tables)))
        queries[name] = round(seconds, 3)
    seconds, values = published_run(spark)
    queries |= {f"published_{name}": round(s, 3) for name, s in seconds.items()}
    ratios = {name: round(seconds[name] / s, 2) for name, s in PUBLISHED_SECONDS.items()}
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(queries.values()), 3),
                "unit": "sec",
                "queries": queries,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
                "cpus": cpus,
                "seconds_over_published": ratios,
                "published_run_objectives": values,
            }
        )
    )


if __name__ == "__main__":
    main()
