"""Nearest-centre assignment, the hot path of every clustering operator."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equipoise.functions.geometry import Centers, center_matrix, nearest_rows, squared_distance

# Up to this many terms (centres times dimensions) an unrolled expression is at least as fast as
# NumPy over Arrow batches. At 64 the compiled method outgrows what the JIT accepts and takes
# thirty times as long, so the limit keeps clear of that for the operators fused with it.
LITERAL_TERMS = 24


def _dimension_error(dim: int) -> str:
    return f"every point must have {dim} coordinates, none of them null"


def coords_to_numpy(column: pa.Array, dim: int) -> np.ndarray:
    """An Arrow ``array<double>`` column as an n x dim matrix, without a copy."""
    values = column.flatten()
    widths = np.diff(column.offsets.to_numpy())
    if column.null_count or values.null_count or (widths != dim).any():
        raise ValueError(_dimension_error(dim))
    return values.to_numpy(zero_copy_only=False).reshape(-1, dim)


def _arrow_nearest(matrix: np.ndarray) -> Callable[[Column | str], Column]:
    @F.arrow_udf("struct<cluster:int,sq_dist:double>")
    def nearest(coords: pa.Array) -> pa.Array:
        index, sq_dist = nearest_rows(coords_to_numpy(coords, matrix.shape[1]), matrix)
        return pa.StructArray.from_arrays([pa.array(index), pa.array(sq_dist)], ["cluster", "sq_dist"])

    return nearest


def uses_literals(*matrices: np.ndarray) -> bool:
    """Whether sets of centres that one stage assigns to are few enough terms together."""
    return sum(m.size for m in matrices) <= LITERAL_TERMS


def assign(
    points: DataFrame,
    centers: Centers,
    coords_col: str = "coords",
    cluster_col: str = "cluster",
    sq_dist_col: str = "sq_dist",
    literals: bool | None = None,
) -> DataFrame:
    """Add the index of the nearest centre and the squared distance to it.

    No shuffle and no join: few terms become one compiled expression, more run as a matrix
    product over Arrow batches, to which Spark ships the coordinates only. ``literals`` overrides
    that choice.
    """
    matrix = center_matrix(centers)
    if literals is None:
        literals = uses_literals(matrix)
    coords = F.col(coords_col)
    keep = [F.col(c) for c in points.columns]
    if not literals:
        found = points.withColumn("_nearest", _arrow_nearest(matrix)(coords))
        return found.select(
            *keep,
            F.col("_nearest.cluster").alias(cluster_col),
            F.col("_nearest.sq_dist").alias(sq_dist_col),
        )
    dim = matrix.shape[1]
    # A wrong size leaves no distances and a null coordinate leaves none that is not null.
    dists = F.when(F.size(coords) == dim, F.array(*[squared_distance(coords, c) for c in matrix]))
    failure = F.raise_error(F.lit(_dimension_error(dim))).cast("double")
    lowest = F.coalesce(F.array_min("_dists"), failure)
    measured = points.withColumn("_dists", dists).withColumn("_lowest", lowest)
    # The first of equal distances is found, so ties go to the lowest index. Being declared not
    # null keeps a join on the cluster from evaluating all of this a second time as a filter.
    position = F.coalesce(F.array_position("_dists", F.col("_lowest")), F.lit(1))
    return measured.select(
        *keep, (position - 1).cast("int").alias(cluster_col), F.col("_lowest").alias(sq_dist_col)
    )
