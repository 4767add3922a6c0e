"""Squared distances and nearest centres, as column expressions and as a NumPy kernel."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Centres live on the driver and travel with every task, which sums three groups for each of
# them: at the limit some 250 MB.
MAX_CENTER_VALUES = 5_000_000

# Doubles in one block of the points-by-centres matrix; 4 MB stays inside a core's cache share.
_BLOCK_VALUES = 500_000

Centers = DataFrame | Sequence[Sequence[float]] | np.ndarray


def center_matrix(centers: Centers) -> np.ndarray:
    """Centres as a K x d matrix, whose row number is the centre's identity.

    A frame must have ``center_id`` 0..K-1 and ``coords``.
    """
    if isinstance(centers, DataFrame):
        # Known before anything is pulled: the values, not the rows, are what is bounded.
        size = centers.agg(F.coalesce(F.sum(F.size("coords").cast("bigint")), F.lit(0))).first()[0]
        _check_size(size)
        rows = centers.select("center_id", "coords").toPandas()
        rows = rows.sort_values("center_id")
        if list(rows["center_id"]) != list(range(len(rows))):
            raise ValueError("center_id must number the centres 0..K-1")
        centers = list(rows["coords"])
    matrix = np.array([np.asarray(c, dtype=np.float64) for c in centers], dtype=np.float64)
    if matrix.ndim != 2 or matrix.size == 0:
        raise ValueError("centres must be a non-empty list of points of one dimension")
    _check_size(matrix.size)
    if not np.isfinite(matrix).all():
        raise ValueError("centres must be finite")
    return matrix


def _check_size(values: int) -> None:
    if values > MAX_CENTER_VALUES:
        raise ValueError(f"centres hold {values} values, more than {MAX_CENTER_VALUES}")


def squared_distance(coords: Column, center: Sequence[float]) -> Column:
    """Squared Euclidean distance to a given point, unrolled over the dimensions."""
    total = None
    for j, value in enumerate(center):
        gap = coords[j] - F.lit(float(value))
        total = gap * gap if total is None else total + gap * gap
    return total


def nearest_rows(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest centre of every row; ties go to the lowest index.

    One matrix product ranks the centres. Its rounding error is bounded, so only rows whose two
    best candidates are closer than that bound are compared again by direct differences.
    """
    n, d = x.shape
    k = len(centers)
    index = np.empty(n, dtype=np.int32)
    sq_dist = np.empty(n, dtype=np.float64)
    origin = centers.mean(axis=0)
    c = centers - origin
    c_sq = np.einsum("ij,ij->i", c, c)
    c_max = c_sq.max()
    minus_two_ct = np.ascontiguousarray(-2.0 * c.T)
    slack = 16.0 * (d + 8) * np.finfo(np.float64).eps
    step = max(64, _BLOCK_VALUES // k)
    for lo in range(0, n, step):
        raw = x[lo:lo + step]
        xs = raw - origin
        ranked = xs @ minus_two_ct
        ranked += c_sq
        best = ranked.argmin(axis=1)
        if k > 1:
            rows = np.arange(len(xs))
            lowest = ranked[rows, best]
            ranked[rows, best] = np.inf
            bound = slack * (np.einsum("ij,ij->i", xs, xs) + c_max)
            close = np.flatnonzero(ranked.min(axis=1) - lowest <= bound)
            for part in np.array_split(close, max(1, -(-len(close) * k // _BLOCK_VALUES))):
                best[part] = _direct_distances(raw[part], centers).argmin(axis=1)
        gap = raw - centers[best]
        index[lo:lo + step] = best
        sq_dist[lo:lo + step] = np.einsum("ij,ij->i", gap, gap)
    return index, sq_dist


def nearest_sq_dists(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distance to the nearest centre of every row, without settling which of two centres
    that are equally near up to rounding it is."""
    sq_dist = np.empty(len(x))
    origin = centers.mean(axis=0)
    c = centers - origin
    # One more coordinate carries the centres' squares, so the product alone ranks them.
    ranking = np.vstack([-2.0 * c.T, np.einsum("ij,ij->i", c, c)])
    step = max(64, _BLOCK_VALUES // len(centers))
    lifted = np.ones((min(step, len(x)), x.shape[1] + 1))
    for lo in range(0, len(x), step):
        raw = x[lo : lo + step]
        rows = lifted[: len(raw)]
        np.subtract(raw, origin, out=rows[:, :-1])
        gap = raw - centers[(rows @ ranking).argmin(axis=1)]
        sq_dist[lo : lo + step] = np.einsum("ij,ij->i", gap, gap)
    return sq_dist


def second_distances(x: np.ndarray, centers: np.ndarray, nearest: np.ndarray) -> np.ndarray:
    """A lower bound of each row's distance to any centre but its nearest one."""
    lower = np.full(len(x), np.inf)
    k, d = centers.shape
    if k == 1:
        return lower
    origin = centers.mean(axis=0)
    c = centers - origin
    c_sq = np.einsum("ij,ij->i", c, c)
    slack = 16.0 * (d + 8) * np.finfo(np.float64).eps
    step = max(64, _BLOCK_VALUES // k)
    for lo in range(0, len(x), step):
        xs = x[lo : lo + step] - origin
        x_sq = np.einsum("ij,ij->i", xs, xs)
        ranked = xs @ (-2.0 * c.T)
        ranked += c_sq
        ranked[np.arange(len(xs)), nearest[lo : lo + step]] = np.inf
        found = ranked.min(axis=1) + x_sq - slack * (x_sq + c_sq.max())
        lower[lo : lo + step] = np.sqrt(np.maximum(found, 0.0))
    return lower


def _direct_distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    total = np.zeros((len(x), len(centers)))
    for j in range(x.shape[1]):
        gap = x[:, j, None] - centers[None, :, j]
        gap *= gap
        total += gap
    return total
