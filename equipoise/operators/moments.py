"""Counts, costs and coordinate sums per (cluster, group): one pass that feeds every report.

All clustering results of a round are sums over points, so they fold from these at most 3K rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equipoise.functions.geometry import Centers, center_matrix, nearest_rows, nearest_sq_dists
from equipoise.operators.assignment import assign, coords_to_numpy, uses_literals
from equipoise.operators.objectives import GROUP_A, GROUP_B

CODE_A, CODE_B, CODE_OTHER = 0, 1, 2

# Sums travel in chunks of at most this many columns, which keeps the aggregate compiled for any
# dimension.
_MAX_CHUNK = 32

# Up to this many partial sums (16 MB) go straight to the driver; more are added up by a shuffle.
_DRIVER_VALUES = 2_000_000


def group_code(group_col: str = "grp") -> Column:
    """0 for A, 1 for B, 2 for any other label."""
    grp = F.col(group_col)
    code = F.when(grp == GROUP_A, CODE_A).when(grp == GROUP_B, CODE_B).otherwise(CODE_OTHER)
    return code.cast("tinyint")


def pack_points(points: DataFrame, dim: int) -> DataFrame:
    """Points as blocks, one row per Arrow batch: a coordinate matrix and a vector of group codes."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coords = coords_to_numpy(batch.column(0), dim)
            codes = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int8)
            yield pa.RecordBatch.from_arrays(
                [pa.array([coords.tobytes()], pa.binary()), pa.array([codes.tobytes()], pa.binary())],
                ["coords", "codes"],
            )

    source = points.select("coords", group_code().alias("code"))
    return source.mapInArrow(pack, "coords binary, codes binary")


@dataclass(frozen=True)
class PackedPoints:
    """Persisted blocks of points that are read again and again; see ``packed``."""

    points: DataFrame
    blocks: DataFrame
    dim: int
    tasks: int


@contextmanager
def packed(points: DataFrame) -> Iterator[PackedPoints]:
    """Persist the points as blocks while the context lasts.

    Blocks reach the workers of every pass as plain memory, without converting single values
    again. A lost executor costs the rebuild of its own blocks.
    """
    first = points.select(F.size("coords").alias("dim")).first()
    if first is None:
        raise ValueError("there are no points")
    blocks = pack_points(points, first.dim).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield PackedPoints(points, blocks, first.dim, blocks.rdd.getNumPartitions())
    finally:
        blocks.unpersist()


def block_moments(blocks: DataFrame, centers: Centers, tasks: int | None = None) -> DataFrame:
    """Moments of packed points; see ``point_moments``.

    If the number of tasks is given and bounds the partial sums, they are not shuffled.
    """
    matrix = center_matrix(centers)
    dim = matrix.shape[1]

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _Accumulator(matrix)
        for x, codes in rows_of_blocks(batches, dim):
            total.add(x, codes)
        yield total.to_arrow()

    partials = blocks.mapInArrow(partial, _partial_schema(dim))
    if tasks is not None and tasks * 3 * len(matrix) * (2 + dim) <= _DRIVER_VALUES:
        return partials
    return _merge(partials, dim)


def rows_of_blocks(batches: Iterable[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(coordinates, group codes)`` of every block."""
    for batch in batches:
        for coords, codes in zip(batch.column(0), batch.column(1)):
            x = np.frombuffer(coords.as_buffer(), dtype=np.float64).reshape(-1, dim)
            yield x, np.frombuffer(codes.as_buffer(), dtype=np.int8)


def joint_moments(points: PackedPoints, sets: Sequence[np.ndarray]) -> list[MomentTable]:
    """Moments for several sets of centres from one pass over the blocks.

    The clusters of all sets are numbered through, so that their sums travel and add up as those
    of one set.
    """
    dim = points.dim
    sizes = [len(m) for m in sets]
    firsts = [sum(sizes[:i]) for i in range(len(sets))]

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [_Accumulator(m) for m in sets]
        for x, codes in rows_of_blocks(batches, dim):
            for total in totals:
                total.add(x, codes)
        for first, total in zip(firsts, totals):
            yield total.to_arrow(first)

    partials = points.blocks.mapInArrow(partial, _partial_schema(dim))
    if points.tasks * 3 * sum(sizes) * (2 + dim) > _DRIVER_VALUES:
        partials = _merge(partials, dim)
    table = MomentTable.collect(partials, sum(sizes), dim)
    return [
        MomentTable(table.n[:, a : a + k], table.cost[:, a : a + k], table.sums[:, a : a + k])
        for a, k in zip(firsts, sizes)
    ]


@dataclass(frozen=True)
class GroupCosts:
    """Points and summed cost of each group (A, B, other) for one set of centres."""

    n: np.ndarray
    cost: np.ndarray

    @property
    def delta(self) -> float | None:
        """The standard objective, over all labels."""
        return float(self.cost.sum() / self.n.sum()) if self.n.any() else None

    @property
    def phi(self) -> float:
        """The fair objective: what the worse-off group pays."""
        return float((self.cost / np.maximum(self.n, 1))[[CODE_A, CODE_B]].max())


def joint_costs(points: PackedPoints, sets: Sequence[np.ndarray]) -> list[GroupCosts]:
    """What several sets of centres cost each group, from one pass that keeps no sums of
    coordinates and settles no ties between centres."""
    dim = points.dim

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, cost = np.zeros(3, np.int64), np.zeros((len(sets), 3))
        for x, codes in rows_of_blocks(batches, dim):
            n += np.bincount(codes, minlength=3)
            for i, matrix in enumerate(sets):
                cost[i] += np.bincount(codes, nearest_sq_dists(x, matrix), minlength=3)
        ids, codes = np.divmod(np.arange(3 * len(sets)), 3)
        columns = [ids.astype(np.int32), codes.astype(np.int8), n[codes], cost.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "code", "n", "cost"])

    partials = points.blocks.mapInArrow(partial, "id int, code tinyint, n bigint, cost double")
    if points.tasks * len(sets) * 12 > _DRIVER_VALUES:
        partials = partials.groupBy("id", "code").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"))
    rows = partials.toArrow()
    n, cost = np.zeros((len(sets), 3), np.int64), np.zeros((len(sets), 3))
    key = (rows["id"].to_numpy(), rows["code"].to_numpy())
    np.add.at(n, key, rows["n"].to_numpy())
    np.add.at(cost, key, rows["cost"].to_numpy())
    return [GroupCosts(*x) for x in zip(n, cost)]


def group_sizes(points: PackedPoints) -> np.ndarray:
    """Points of each group (A, B, other). Reads the codes only, and builds the blocks if this is
    the first pass over them."""

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(3, np.int64)
        for batch in batches:
            for codes in batch.column(0):
                n += np.bincount(np.frombuffer(codes.as_buffer(), np.int8), minlength=3)
        yield pa.RecordBatch.from_arrays([pa.array([int(v)]) for v in n], ["a", "b", "other"])

    counts = points.blocks.select("codes").mapInArrow(partial, "a bigint, b bigint, other bigint")
    return np.array(counts.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("a", "b", "other")]).first(), np.int64)


def only_two_groups(sizes: np.ndarray) -> np.ndarray:
    """The sizes themselves, where only the groups A and B make sense."""
    if sizes[CODE_OTHER]:
        raise ValueError(f"group label must be A or B: {sizes[CODE_OTHER]} points have another")
    return sizes


def point_moments(points: DataFrame, centers: Centers) -> DataFrame:
    """``(cluster, code, chunk, n, v0, v1, ...)`` of the clusters and groups that hold points.

    ``n`` counts the points. The values of a key, over its chunks, are the summed squared
    distance to the centre and then the vector sum. ``MomentTable`` reads these rows.
    """
    matrix = center_matrix(centers)
    dim = matrix.shape[1]
    source = points.select("coords", group_code().alias("code"))
    if uses_literals(matrix) and dim < _MAX_CHUNK:
        sums = [F.sum("sq_dist"), *[F.sum(F.col("coords")[j]) for j in range(dim)]]
        return (
            assign(source, matrix)
            .groupBy("cluster", "code", F.lit(0).alias("chunk"))
            .agg(F.count("*").alias("n"), *[s.alias(f"v{i}") for i, s in enumerate(sums)])
        )

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _Accumulator(matrix)
        for batch in batches:
            codes = batch.column(1).to_numpy(zero_copy_only=False)
            total.add(coords_to_numpy(batch.column(0), dim), codes)
        yield total.to_arrow()

    return _merge(source.mapInArrow(partial, _partial_schema(dim)), dim)


def costs_around(points: DataFrame | PackedPoints, centers: np.ndarray, means: np.ndarray) -> np.ndarray:
    """Summed squared distances to ``means[group, cluster]``, the clusters being those of
    ``centers``: ``[group, cluster]``. One pass over the points."""
    k, dim = centers.shape
    flat = np.concatenate([means, np.zeros((3 - len(means), k, dim))]).transpose(1, 0, 2).reshape(-1, dim)

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3 * k)
        for batch in batches:
            for x, codes in rows_of(batch):
                key = nearest_rows(x, centers)[0] * 3 + codes
                gap = x - flat[key]
                total += np.bincount(key, np.einsum("ij,ij->i", gap, gap), minlength=3 * k)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["key", "cost"])

    if isinstance(points, PackedPoints):
        source = points.blocks

        def rows_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for coords, codes in zip(batch.column(0), batch.column(1)):
                yield np.frombuffer(coords.as_buffer(), np.float64).reshape(-1, dim), np.frombuffer(codes.as_buffer(), np.int8)
    else:
        source = points.select("coords", group_code().alias("code"))

        def rows_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            yield coords_to_numpy(batch.column(0), dim), batch.column(1).to_numpy(zero_copy_only=False)

    rows = source.mapInArrow(partial, "key int, cost double").groupBy("key").agg(F.sum("cost").alias("cost")).toArrow()
    out = np.zeros(3 * k)  # at most a few values per centre
    out[rows["key"].to_numpy()] = rows["cost"].to_numpy()
    return out.reshape(k, 3).T


class _Accumulator:
    """Running sums of one task, indexed by cluster * 3 + group code."""

    def __init__(self, matrix: np.ndarray) -> None:
        self.matrix = matrix
        keys = 3 * len(matrix)
        self.n = np.zeros(keys, dtype=np.int64)
        self.sums = np.zeros((1 + matrix.shape[1], keys))

    def add(self, x: np.ndarray, codes: np.ndarray) -> None:
        self.add_assigned(x, codes, *nearest_rows(x, self.matrix))

    def add_assigned(self, x: np.ndarray, codes: np.ndarray, index: np.ndarray, sq_dist: np.ndarray) -> None:
        key = index * 3 + codes
        keys = len(self.n)
        self.n += np.bincount(key, minlength=keys)
        self.sums[0] += np.bincount(key, sq_dist, minlength=keys)
        for j in range(x.shape[1]):
            self.sums[1 + j] += np.bincount(key, x[:, j], minlength=keys)

    def to_arrow(self, offset: int = 0) -> pa.RecordBatch:
        """The sums as rows; clusters are numbered from ``offset``."""
        key = np.flatnonzero(self.n)
        names = _sum_columns(len(self.sums) - 1)
        width = len(names)
        chunks = -(-len(self.sums) // width)
        values = np.zeros((chunks * width, len(key)))
        values[: len(self.sums)] = self.sums[:, key]
        # Stack the chunks below each other, so that a row is one (key, chunk).
        values = values.reshape(chunks, width, len(key)).transpose(1, 0, 2).reshape(width, -1)
        first = np.repeat(np.arange(chunks) == 0, len(key))
        columns = [
            pa.array(np.tile(offset + key // 3, chunks).astype(np.int32)),
            pa.array(np.tile(key % 3, chunks).astype(np.int8)),
            pa.array(np.repeat(np.arange(chunks), len(key)).astype(np.int32)),
            pa.array(np.where(first, np.tile(self.n[key], chunks), 0)),
            *[pa.array(v) for v in values],
        ]
        return pa.RecordBatch.from_arrays(columns, ["cluster", "code", "chunk", "n", *names])


def _sum_columns(dim: int) -> list[str]:
    """Names of the columns of one chunk; the cost comes before the ``dim`` sums."""
    return [f"v{i}" for i in range(min(_MAX_CHUNK, 1 + dim))]


def _partial_schema(dim: int) -> str:
    sums = ", ".join(f"{c} double" for c in _sum_columns(dim))
    return f"cluster int, code tinyint, chunk int, n bigint, {sums}"


def _merge(partials: DataFrame, dim: int) -> DataFrame:
    """Add up the partial sums of all tasks."""
    sums = [F.sum(c).alias(c) for c in ("n", *_sum_columns(dim))]
    return partials.groupBy("cluster", "code", "chunk").agg(*sums)


@dataclass(frozen=True)
class MomentTable:
    """Collected moments, dense over clusters: the first axis is the group code (A, B, other)."""

    n: np.ndarray
    cost: np.ndarray
    sums: np.ndarray

    @classmethod
    def collect(cls, moments: DataFrame, k: int, dim: int) -> MomentTable:
        """Bring the rows to the driver: a few per centre, and the centres came from there."""
        rows = moments.toArrow()
        key = (rows["code"].to_numpy(), rows["cluster"].to_numpy())
        n = np.zeros((3, k), dtype=np.int64)
        np.add.at(n, key, rows["n"].to_numpy())
        names = _sum_columns(dim)
        chunks = -(-(1 + dim) // len(names))
        values = np.zeros((chunks, len(names), 3, k))
        for i, name in enumerate(names):
            np.add.at(values[:, i], (rows["chunk"].to_numpy(), *key), rows[name].to_numpy())
        values = values.reshape(-1, 3, k)
        return cls(n, values[0], np.moveaxis(values[1 : 1 + dim], 0, -1))

    @classmethod
    def of(cls, points: DataFrame | PackedPoints, centers: np.ndarray) -> MomentTable:
        """One pass over the points."""
        if isinstance(points, PackedPoints):
            if centers.shape[1] != points.dim:
                raise ValueError(f"centres must have {points.dim} coordinates")
            rows = block_moments(points.blocks, centers, points.tasks)
        else:
            rows = point_moments(points, centers)
        return cls.collect(rows, *centers.shape)

    def group_mean(self, code: int) -> float:
        """Mean cost of a group; one without members costs nothing."""
        return float(self.cost[code].sum() / max(1, self.n[code].sum()))

    @property
    def phi(self) -> float:
        """The fair objective: what the worse-off group pays."""
        return max(self.group_mean(CODE_A), self.group_mean(CODE_B))

    @property
    def delta(self) -> float | None:
        """The standard objective, over all labels."""
        return float(self.cost.sum() / self.n.sum()) if self.n.any() else None

    def only_two_groups(self) -> MomentTable:
        """Itself, where only the groups A and B make sense."""
        only_two_groups(self.n.sum(axis=1))
        return self
