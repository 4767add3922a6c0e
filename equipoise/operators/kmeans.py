"""Standard and fair k-means."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equipoise.functions.geometry import Centers, center_matrix
from equipoise.operators.assignment import coords_to_numpy
from equipoise.operators.fair_step import finish_step
from equipoise.operators.lloyd import lloyd_rounds
from equipoise.operators.moments import (
    CODE_A,
    CODE_B,
    MomentTable,
    PackedPoints,
    group_sizes,
    only_two_groups,
    packed,
    rows_of_blocks,
)
from equipoise.operators.objectives import centers_frame

# The seed of the centre initialisation and the move that counts as standing still.
DEFAULT_SEED = 123
DEFAULT_TOL = 1e-4

# Candidates of a sampled start for each wanted centre.
OVERSAMPLING = 4


def _train(points: DataFrame, k: int, max_iter: int, seed: int) -> np.ndarray:
    # Not persisted here: the trainer caches its own form when its input is not cached. Its row
    # solver skips most centres by the triangle inequality, which beats block products on data
    # that has clusters.
    vectors = points.select(array_to_vector("coords").alias("features"))
    trainer = KMeans(
        k=k, maxIter=max_iter, seed=seed, initMode="k-means||", initSteps=2, tol=DEFAULT_TOL, solver="row"
    )
    return np.array(trainer.fit(vectors).clusterCenters())


def _mean(points: DataFrame) -> np.ndarray:
    vectors = points.select(array_to_vector("coords").alias("features"))
    return np.array([vectors.select(Summarizer.mean(F.col("features"))).first()[0].toArray()])


def _check(k: int, max_iter: int) -> None:
    if k < 1:
        raise ValueError("k must be at least 1")
    if max_iter < 0:
        raise ValueError("max_iter must not be negative")


def standard_kmeans(points: DataFrame, k: int, max_iter: int, seed: int = DEFAULT_SEED) -> DataFrame:
    """``(center_id, coords)`` of k-means from a k-means|| start, blind to the groups."""
    _check(k, max_iter)
    if max_iter == 0:
        return initial_centers(points, k, seed)
    # The trainer wants two centres; one centre is the mean.
    return centers_frame(points.sparkSession, _mean(points) if k == 1 else _train(points, k, max_iter, seed))


def standard_lloyd(
    points: DataFrame | PackedPoints, start: Centers, max_iter: int, tol: float = DEFAULT_TOL
) -> DataFrame:
    """``(center_id, coords)`` after at most ``max_iter`` rounds of Lloyd from a given start.

    Ends when no centre moves farther than ``tol``. A centre without points stays where it is.
    """
    if max_iter < 0 or tol < 0:
        raise ValueError("max_iter and tol must not be negative")
    if not isinstance(points, PackedPoints):
        with packed(points) as blocks:
            return standard_lloyd(blocks, start, max_iter, tol)
    return centers_frame(points.points.sparkSession, lloyd_rounds(points, center_matrix(start), max_iter, tol))


def initial_centers(points: DataFrame, k: int, seed: int = DEFAULT_SEED) -> DataFrame:
    """``(center_id, coords)`` of the k-means|| start alone; a single centre is a sampled point."""
    _check(k, 0)
    if k == 1:
        return sampled_centers(points, k, seed)
    return centers_frame(points.sparkSession, _train(points, k, 0, seed))


def _hashes(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of every row's values; zeros of either sign are alike."""
    bits = (x + 0.0).view(np.uint64)
    out = np.full(len(x), (seed * 2 + 1) % (1 << 64), np.uint64)
    for j in range(x.shape[1]):
        out = (out ^ bits[:, j]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _candidates(points: PackedPoints, key: Column | None, seed: int, most: int) -> np.ndarray:
    """The ``most`` points of the smallest keys, one for each key.

    A task keeps its own smallest keys and passes nothing else on, so a point that a third of all
    rows repeat is one candidate and costs one row a task.
    """
    dim = points.dim

    def smallest(parts: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        keys, held = np.empty(0, np.int64), np.empty((0, dim))
        for more, x in parts:
            keys, first = np.unique(np.concatenate((keys, more)), return_index=True)
            keys, held = keys[:most], np.concatenate((held, x))[first[:most]]
        offsets = pa.array(np.arange(len(held) + 1, dtype=np.int32) * dim)
        coords = pa.ListArray.from_arrays(offsets, pa.array(held.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(keys), coords], ["key", "coords"])

    def of_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from smallest((_hashes(x, seed), x) for x, _ in rows_of_blocks(batches, dim))

    def of_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from smallest((b.column(0).to_numpy(zero_copy_only=False), coords_to_numpy(b.column(1), dim)) for b in batches)

    kept = "key bigint, coords array<double>"
    if key is None:
        found = points.blocks.mapInArrow(of_blocks, kept)
    else:
        found = points.points.select(key.cast("bigint").alias("key"), "coords").mapInArrow(of_rows, kept)
    rows = found.groupBy("key").agg(F.min("coords").alias("coords")).orderBy("key").limit(most).collect()
    return np.array([row.coords for row in rows], dtype=np.float64)


def _reduced(candidates: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """``k`` of the candidates: the heaviest, then always the one of the highest weight times
    squared distance to those chosen. The first of equals is taken."""
    chosen = [int(weights.argmax())]
    left = np.full(len(candidates), np.inf)
    while len(chosen) < k:
        gap = candidates - candidates[chosen[-1]]
        left = np.minimum(left, np.einsum("ij,ij->i", gap, gap))
        worth = weights * left
        if worth.max() <= 0:
            break  # no other point is left
        chosen.append(int(worth.argmax()))
    return candidates[chosen]


def sampled_centers(
    points: DataFrame | PackedPoints, k: int, seed: int = DEFAULT_SEED, key: Column | None = None
) -> DataFrame:
    """``(center_id, coords)``: ``k`` chosen points as a start that does not depend on how the rows
    are partitioned.

    Candidates are the ``OVERSAMPLING * k`` points whose hash comes first, weighted by the points
    nearest to each: one pass over the blocks to find them, one to count, and the rest on few rows.
    ``key`` replaces the hash of the coordinates by a bigint of the rows, which are then read again;
    rows of one key must be the same point. Fewer than ``k`` different candidates give fewer centres.
    """
    _check(k, 0)
    if not isinstance(points, PackedPoints):
        with packed(points) as blocks:
            return sampled_centers(blocks, k, seed, key)
    candidates = _candidates(points, key, seed, OVERSAMPLING * k)
    weights = MomentTable.of(points, center_matrix(candidates)).n.sum(axis=0)
    return centers_frame(points.points.sparkSession, _reduced(candidates, weights, k))


def fair_kmeans(
    points: DataFrame | PackedPoints,
    k: int,
    max_iter: int,
    seed: int = DEFAULT_SEED,
    start: Centers | None = None,
) -> DataFrame:
    """``(center_id, coords)`` after exactly ``max_iter`` rounds of fair Lloyd.

    ``start`` replaces the k-means|| start. If a group has no points, standard k-means answers.
    Labels are checked before anything is trained. Each round depends on the persisted blocks and
    K literal centres only, so lineage stays flat however many rounds run.
    """
    _check(k, max_iter)
    if not isinstance(points, PackedPoints):
        with packed(points) as blocks:
            return fair_kmeans(blocks, k, max_iter, seed, start)
    sizes = only_two_groups(group_sizes(points))
    if not (sizes[CODE_A] and sizes[CODE_B]):
        if start is None:
            return standard_kmeans(points.points, k, max_iter, seed)
        return standard_lloyd(points, start, max_iter)
    matrix = center_matrix(initial_centers(points.points, k, seed) if start is None else start)
    for _ in range(max_iter):
        matrix = finish_step(MomentTable.of(points, matrix), matrix, points).centers
    return centers_frame(points.points.sparkSession, matrix)
