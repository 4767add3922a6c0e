from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from equipoise.functions.geometry import center_matrix, nearest_rows
from equipoise.operators import assignment
from equipoise.operators.assignment import assign
from equipoise.operators.objectives import centers_frame


def brute_force(x, centers):
    index, dist = [], []
    for p in x:
        best = None
        for i, c in enumerate(centers):
            d = 0.0
            for a, b in zip(p, c):
                d += (a - b) * (a - b)
            if best is None or d < best[0]:
                best = (d, i)
        index.append(best[1])
        dist.append(best[0])
    return np.array(index), np.array(dist)


grid = st.integers(-3, 3).map(float)
spread = st.floats(-1e6, 1e6, allow_nan=False, width=32)


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_kernel_finds_the_lowest_of_equal_centers(data):
    dim = data.draw(st.integers(1, 5))
    value = data.draw(st.sampled_from([grid, spread]))
    point = st.lists(value, min_size=dim, max_size=dim)
    x = np.array(data.draw(st.lists(point, min_size=1, max_size=20)))
    centers = np.array(data.draw(st.lists(point, min_size=1, max_size=12)))
    index, dist = nearest_rows(x, centers)
    want_index, want_dist = brute_force(x, centers)
    assert (index == want_index).all()
    np.testing.assert_allclose(dist, want_dist, rtol=1e-12)


def test_kernel_with_many_blocks(monkeypatch):
    from equipoise.functions import geometry

    monkeypatch.setattr(geometry, "_BLOCK_VALUES", 700)
    rng = np.random.default_rng(1)
    x, centers = rng.integers(0, 5, (1000, 3)).astype(float), rng.integers(0, 5, (9, 3)).astype(float)
    index, dist = nearest_rows(x, centers)
    want_index, want_dist = brute_force(x, centers)
    assert (index == want_index).all() and np.allclose(dist, want_dist)


def test_kernel_far_from_the_origin():
    """Ranking must not lose close centres to cancellation."""
    rng = np.random.default_rng(2)
    x = 1e8 + rng.random((300, 2))
    centers = 1e8 + rng.random((6, 2))
    index, dist = nearest_rows(x, centers)
    want_index, want_dist = brute_force(x, centers)
    assert (index == want_index).all() and np.allclose(dist, want_dist)


@pytest.mark.parametrize("terms", [0, 10_000])
def test_both_paths_agree(points_of, monkeypatch, terms):
    monkeypatch.setattr(assignment, "LITERAL_TERMS", terms)
    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, (200, 2)).astype(float)
    centers = rng.integers(0, 6, (7, 2)).astype(float)
    rows = assign(points_of([(p, "A") for p in x]), centers).orderBy("point_id").collect()
    want_index, want_dist = brute_force(x, centers)
    assert [r.cluster for r in rows] == want_index.tolist()
    np.testing.assert_allclose([r.sq_dist for r in rows], want_dist)


@pytest.mark.parametrize("terms", [0, 10_000])
def test_tie_goes_to_the_first(points_of, monkeypatch, terms):
    monkeypatch.setattr(assignment, "LITERAL_TERMS", terms)
    row = assign(points_of([((0, 0), "A")]), [(-1, 0), (1, 0)]).first()
    assert (row.cluster, row.sq_dist) == (0, 1.0)


@pytest.mark.parametrize("terms", [0, 10_000])
@pytest.mark.parametrize("bad", [[1.0], [1.0, 2.0, 3.0], None, [1.0, None]])
def test_wrong_dimension_fails(spark, monkeypatch, terms, bad):
    monkeypatch.setattr(assignment, "LITERAL_TERMS", terms)
    points = spark.createDataFrame([([1.0, 2.0], "A"), (bad, "A")], "coords array<double>, grp string")
    with pytest.raises(Exception, match="coordinates"):
        assign(points, [(0, 0), (1, 1)]).collect()


def test_centers_from_a_frame(spark):
    frame = centers_frame(spark, [(1, 2), (3, 4)])
    assert center_matrix(frame.orderBy("center_id", ascending=False)).tolist() == [[1, 2], [3, 4]]
    with pytest.raises(ValueError, match="center_id"):
        center_matrix(frame.where("center_id = 1"))


@pytest.mark.parametrize("centers", [[], [(1, float("nan"))], [(1, 2), (3,)]])
def test_bad_centers(centers):
    with pytest.raises(ValueError):
        center_matrix(centers)
