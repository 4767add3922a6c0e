"""Writing clustered points as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equipoise.functions.geometry import Centers, center_matrix
from equipoise.operators.assignment import assign

# Fixed value: the number format of the text files.
_COORDINATE = "%.3f"


def clustered_point_lines(points: DataFrame, centers: Centers, dims: int | None = None) -> DataFrame:
    """``line``: coordinates with three decimals, first letter of the group, nearest centre.

    ``dims`` limits the coordinates written (two for plotting tools); all by default.
    """
    matrix = center_matrix(centers)
    dim = matrix.shape[1] if dims is None else dims
    if not 1 <= dim <= matrix.shape[1]:
        raise ValueError(f"dims must lie in 1..{matrix.shape[1]}")
    line = F.format_string(
        ",".join([_COORDINATE] * dim + ["%s", "%d"]),
        *[F.col("coords")[j] for j in range(dim)],
        F.substring("grp", 1, 1),
        F.col("cluster"),
    )
    return assign(points.select("coords", "grp"), matrix).select(line.alias("line"))


def write_clustered_points(
    points: DataFrame, centers: Centers, path: str, dims: int | None = None, mode: str = "errorifexists"
) -> None:
    """Write ``clustered_point_lines`` as a folder of text files, one per task."""
    clustered_point_lines(points, centers, dims).write.mode(mode).text(path)
