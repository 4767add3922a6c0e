"""Rounds of standard Lloyd over packed points, most distances skipped by the triangle inequality.

Once the centres have settled, the points are *anchored*: kept, beside their coordinates, with their
nearest centre at that time, the distance to it and a lower bound of the distance to any other. In a
later round a point whose two bounds, loosened by how far the centres have moved since, do not meet
still belongs to the same centre: one distance instead of K. Anchored blocks are written once and only
read afterwards, and always come from the packed blocks, so lineage stays flat and a lost executor
rebuilds its own. When too many points have to be compared again, the next round anchors anew.
Results are those of plain rounds.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame

from equipoise.functions.geometry import nearest_rows, second_distances
from equipoise.operators.moments import (
    _DRIVER_VALUES,
    MomentTable,
    PackedPoints,
    _Accumulator,
    _merge,
    _partial_schema,
    rows_of_blocks,
)

# Centres have settled when none moved farther than this share of a point's typical distance.
SETTLED = 0.5
# Share of points compared again from which anchoring anew pays.
STALE = 0.4
# Writing anchored blocks costs a few plain rounds, so as many must be left.
WORTH_ROUNDS = 5
# Bounds closer than this, relative to their size, count as meeting: rounding stays far below.
MARGIN = 1e-9


@dataclass(frozen=True)
class Anchored:
    """Blocks with the bounds that held for the centres ``anchor``."""

    frame: DataFrame
    anchor: np.ndarray


def anchored(points: PackedPoints, centers: np.ndarray) -> Anchored:
    """Persisted ``(coords, codes, nearest, upper, lower)``; filled by the first pass over it."""
    dim = points.dim

    def bound(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, codes in rows_of_blocks(batches, dim):
            index, sq_dist = nearest_rows(x, centers)
            parts = (x, codes, index, np.sqrt(sq_dist), second_distances(x, centers, index))
            yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], names)

    names = ["coords", "codes", "nearest", "upper", "lower"]
    frame = points.blocks.mapInArrow(bound, ", ".join(f"{n} binary" for n in names))
    return Anchored(frame.persist(StorageLevel.MEMORY_AND_DISK), centers)


def bounded_moments(points: PackedPoints, held: Anchored, centers: np.ndarray) -> tuple[MomentTable, int]:
    """The moments of a round, and how many points were compared with all centres."""
    k, dim = centers.shape
    moved = np.sqrt(np.einsum("ij,ij->i", centers - held.anchor, centers - held.anchor))
    most = int(moved.argmax())
    others = np.full(k, moved[most])  # how far any other centre may have come
    others[most] = np.delete(moved, most).max(initial=0.0)

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, compared = _Accumulator(centers), 0
        for batch in batches:
            for coords, codes, nearest, upper, lower in zip(*batch.columns):
                x = np.frombuffer(coords.as_buffer()).reshape(-1, dim)
                index = np.frombuffer(nearest.as_buffer(), np.int32)
                high = np.frombuffer(upper.as_buffer()) + moved[index]
                low = np.frombuffer(lower.as_buffer()) - others[index]
                open_ = np.flatnonzero(high * (1 + MARGIN) >= low * (1 - MARGIN))
                gap = x - centers[index]
                sq_dist = np.einsum("ij,ij->i", gap, gap)
                if len(open_):
                    index = index.copy()
                    index[open_], sq_dist[open_] = nearest_rows(x[open_], centers)
                    compared += len(open_)
                total.add_assigned(x, np.frombuffer(codes.as_buffer(), np.int8), index, sq_dist)
        yield total.to_arrow()
        row = {name: [0] for name in total_names}
        row |= {"cluster": [k], "n": [compared]}
        yield pa.RecordBatch.from_pydict(row).cast(total_schema)

    schema = _partial_schema(dim)
    total_schema = _Accumulator(centers).to_arrow().schema
    total_names = total_schema.names
    partials = held.frame.mapInArrow(partial, schema)
    if points.tasks * 3 * k * (2 + dim) > _DRIVER_VALUES:
        partials = _merge(partials, dim)
    table = MomentTable.collect(partials, k + 1, dim)
    return MomentTable(table.n[:, :k], table.cost[:, :k], table.sums[:, :k]), int(table.n[0, k])


def mean_centers(moments: MomentTable, centers: np.ndarray) -> np.ndarray:
    """The mean of each cluster; an empty one keeps its centre."""
    n, sums = moments.n.sum(axis=0), moments.sums.sum(axis=0)
    return np.where((n > 0)[:, None], sums / np.maximum(n, 1)[:, None], centers)


def largest_move(old: np.ndarray, new: np.ndarray) -> float:
    return float(np.sqrt(np.einsum("ij,ij->i", new - old, new - old).max()))


def lloyd_rounds(points: PackedPoints, start: np.ndarray, max_iter: int, tol: float) -> np.ndarray:
    """Centres after at most ``max_iter`` rounds; ends when none moves farther than ``tol``."""
    centers, held, anchor_next = start, None, False
    try:
        for done in range(max_iter):
            if anchor_next and max_iter - done >= WORTH_ROUNDS:
                if held is not None:
                    held.frame.unpersist()
                held = anchored(points, centers)
            if held is None:
                moments, compared = MomentTable.of(points, centers), 0
            else:
                moments, compared = bounded_moments(points, held, centers)
            new = mean_centers(moments, centers)
            move, n = largest_move(centers, new), max(1, int(moments.n.sum()))
            spread = float(np.sqrt(moments.cost.sum() / n))
            anchor_next = move <= SETTLED * spread and (held is None or compared > STALE * n)
            centers = new
            if move <= tol:
                break
    finally:
        if held is not None:
            held.frame.unpersist()
    return centers
