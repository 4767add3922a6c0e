from __future__ import annotations

import pytest

from equipoise.operators import assignment
from equipoise.operators import objectives as obj
from equipoise.plans.reports import group_statistics

CENTERS = [(0, 0), (10, 0), (100, 100)]
ROWS = [((1, 0), "A"), ((0, 2), "B"), ((9, 0), "B"), ((10, 3), "C"), ((12, 0), "A"), ((12, 0), "A")]


def test_counts_keep_foreign_labels_in_the_total(points_of):
    assert tuple(obj.group_counts(points_of(ROWS)).first()) == (6, 3, 2)


def test_objectives(points_of):
    points = points_of(ROWS)
    assert obj.standard_objective(points, CENTERS).first().delta == pytest.approx((1 + 4 + 1 + 9 + 4 + 4) / 6)
    row = obj.fair_objective(points, CENTERS).first()
    assert (row.mean_a, row.mean_b, row.phi) == pytest.approx((3.0, 2.5, 3.0))


def test_missing_group_costs_nothing(points_of):
    row = obj.fair_objective(points_of([((1, 0), "A")]), CENTERS).first()
    assert tuple(row) == (1.0, 0.0, 1.0)


@pytest.mark.parametrize("counts", [obj.cluster_group_counts, obj.cluster_group_counts_salted])
def test_cluster_counts_include_empty_clusters(points_of, counts):
    rows = counts(points_of(ROWS), CENTERS).orderBy("cluster").collect()
    assert [tuple(r) for r in rows] == [(0, 1, 1), (1, 2, 1), (2, 0, 0)]


def test_salt_may_come_from_a_column(points_of):
    rows = obj.cluster_group_counts_salted(points_of(ROWS), CENTERS, 2, "point_id").orderBy("cluster")
    assert [tuple(r) for r in rows.collect()] == [(0, 1, 1), (1, 2, 1), (2, 0, 0)]
    with pytest.raises(ValueError):
        obj.cluster_group_counts_salted(points_of(ROWS), CENTERS, 0)


@pytest.mark.parametrize("terms", [0, 32])
def test_statistics_fold_from_one_pass(points_of, monkeypatch, terms):
    monkeypatch.setattr(assignment, "LITERAL_TERMS", terms)
    points = points_of(ROWS)
    totals, clusters = group_statistics(points, CENTERS)
    assert tuple(totals.first()) == pytest.approx((6, 3, 2, 23 / 6, 3.0))
    assert [tuple(r) for r in clusters.orderBy("center_id").collect()] == [
        (0, [0.0, 0.0], 1, 1),
        (1, [10.0, 0.0], 2, 1),
        (2, [100.0, 100.0], 0, 0),
    ]


@pytest.mark.parametrize("terms", [0, 24])
def test_compare_objectives(points_of, monkeypatch, terms):
    monkeypatch.setattr(assignment, "LITERAL_TERMS", terms)
    points = points_of(ROWS)
    rows = obj.compare_objectives(points, {"given": CENTERS, "origin": [(0, 0)]}).collect()
    found = {r.method: r.fair_objective for r in rows}
    assert found == pytest.approx({"given": 3.0, "origin": max(289 / 3, 85 / 2)})


def test_larger_mean_is_at_least_the_overall_mean(points_of):
    points = points_of([(c, "A" if i % 3 else "B") for i, (c, _) in enumerate(ROWS)])
    delta = obj.standard_objective(points, CENTERS).first().delta
    assert obj.fair_objective(points, CENTERS).first().phi >= delta
