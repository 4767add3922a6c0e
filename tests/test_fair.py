from __future__ import annotations

import numpy as np
import pytest

from equipoise.operators import assignment
from equipoise.operators.fair_step import (
    fair_center_step,
    fair_fixed_costs,
    fair_line_search,
    fair_moments,
    fair_step,
    finish_step,
    line_search,
)
from equipoise.operators.kmeans import (
    fair_kmeans,
    initial_centers,
    sampled_centers,
    standard_kmeans,
    standard_lloyd,
)
from equipoise.operators.lloyd import anchored, bounded_moments
from equipoise.operators.moments import (
    CODE_OTHER,
    MomentTable,
    block_moments,
    group_sizes,
    joint_costs,
    joint_moments,
    pack_points,
    packed,
    point_moments,
)
from equipoise.operators.objectives import fair_objective
from equipoise.plans.reports import (
    clustered_group_statistics,
    compare_training,
    fair_vs_standard,
    group_statistics,
)
from equipoise.sources.mixture import mixture_points


def random_points(n, dim, seed):
    rng = np.random.default_rng(seed)
    grp = rng.choice(["A", "B"], n, p=[0.4, 0.6])
    x = rng.normal(size=(n, dim)) * 4 + (grp == "B")[:, None] * 3 + rng.integers(0, 3, n)[:, None] * 15
    return x, grp


def centers_of(df):
    return np.array([r.coords for r in df.orderBy("center_id").collect()])


@pytest.mark.parametrize("dim", [2, 31, 32, 70])
@pytest.mark.parametrize("packed, tasks", [(False, None), (True, None), (True, 3)])
def test_moments_in_any_dimension(points_of, dim, packed, tasks):
    x, grp = random_points(120, dim, dim)
    grp[:5] = "C"
    centers = x[[0, 40, 80]]
    points = points_of(list(zip(x, grp))).repartition(3)
    frame = block_moments(pack_points(points, dim), centers, tasks) if packed else point_moments(points, centers)
    table = MomentTable.collect(frame, 3, dim)
    dist = ((x[:, None, :] - centers[None]) ** 2).sum(axis=2)
    for cluster in range(3):
        for code, label in enumerate("ABC"):
            member = (dist.argmin(axis=1) == cluster) & (grp == label)
            assert table.n[code, cluster] == member.sum()
            np.testing.assert_allclose(table.cost[code, cluster], dist[member, cluster].sum())
            np.testing.assert_allclose(table.sums[code, cluster], x[member].sum(axis=0), atol=1e-9)
    assert table.n[CODE_OTHER].sum() == 5


def two_pass_step(x, grp, centers):
    """The round as it is defined: means first, then costs around them."""
    cluster = ((x[:, None, :] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
    k, total = len(centers), {g: (grp == g).sum() for g in "AB"}
    share, mean, fixed = {}, {}, {}
    for g in "AB":
        share[g] = np.array([((cluster == i) & (grp == g)).sum() / total[g] for i in range(k)])
        mean[g] = np.array([x[(cluster == i) & (grp == g)].mean(axis=0) for i in range(k)])
        member = grp == g
        fixed[g] = ((x[member] - mean[g][cluster[member]]) ** 2).sum() / total[g]
    ell = np.sqrt(((mean["A"] - mean["B"]) ** 2).sum(axis=1))
    # Try weights on a fine grid instead of bisecting.
    best = None
    for gamma in np.arange(1, 1024) / 1024:
        a, b = gamma * share["A"], (1 - gamma) * share["B"]
        x_new = b * ell / (a + b)
        gap = abs(fixed["A"] + (share["A"] * x_new**2).sum() - fixed["B"] - (share["B"] * (ell - x_new) ** 2).sum())
        if best is None or gap < best[0]:
            best = (gap, x_new)
    t = (best[1] / ell)[:, None]
    return fixed, ell, best[1], (1 - t) * mean["A"] + t * mean["B"]


@pytest.mark.parametrize("terms", [0, 32])
def test_step_against_two_passes(points_of, monkeypatch, terms):
    monkeypatch.setattr(assignment, "LITERAL_TERMS", terms)
    x, grp = random_points(400, 2, 5)
    centers = np.array([(0.0, 0.0), (15.0, 15.0), (30.0, 30.0)])
    step = fair_step(points_of(list(zip(x, grp))), centers)
    fixed, ell, x_new, new_centers = two_pass_step(x, grp, centers)
    assert (step.fixed_a, step.fixed_b) == pytest.approx((fixed["A"], fixed["B"]), rel=1e-9)
    np.testing.assert_allclose(step.ell, ell)
    # Ten halvings leave the weight within 1/1024 of the best one.
    np.testing.assert_allclose(step.x, x_new, atol=0.02)
    np.testing.assert_allclose(step.centers, new_centers, atol=0.02)


def test_line_search_balances_the_groups():
    alpha = beta = np.array([0.5, 0.5])
    ell = np.array([2.0, 4.0])
    np.testing.assert_allclose(line_search(1.0, 1.0, alpha, beta, ell), ell / 2)
    # A costs more whatever is done: its own means are best for it.
    assert (line_search(100.0, 0.0, alpha, beta, ell) < 0.01 * ell).all()
    assert (line_search(0.0, 100.0, alpha, beta, ell) > 0.99 * ell).all()


def test_line_search_ignores_empty_clusters():
    x = line_search(1.0, 2.0, np.array([1.0, 0.0]), np.array([1.0, 0.0]), np.array([3.0, 0.0]))
    assert np.isfinite(x).all() and x[1] == 0


def test_single_group_and_empty_clusters(points_of):
    rows = [((0, 0), "A"), ((0, 2), "A"), ((10, 0), "B"), ((12, 0), "A")]
    step = fair_step(points_of(rows), [(0, 0), (11, 0), (500, 500)])
    assert np.isfinite(step.centers).all()
    assert step.centers[0].tolist() == [0, 1]
    assert step.centers[2].tolist() == [500, 500]
    assert step.x[2] == 0 and step.ell[0] == 0


def test_frames_show_the_step(points_of):
    rows = [((0, 0), "A"), ((0, 2), "B"), ((10, 0), "B"), ((12, 0), "A")]
    points, centers = points_of(rows), [(0, 0), (11, 0)]
    moments = fair_moments(points, centers).orderBy("cluster").collect()
    assert tuple(moments[0]) == (0, 1, [0, 0], 1, [0, 2])
    assert tuple(moments[1]) == (1, 1, [12, 0], 1, [10, 0])
    assert tuple(fair_fixed_costs(points, centers).first()) == (0.0, 0.0)
    assert [r.ell for r in fair_line_search(points, centers).orderBy("cluster").collect()] == [2.0, 2.0]
    np.testing.assert_allclose(centers_of(fair_center_step(points, centers)), [(0, 1), (11, 0)])


@pytest.mark.parametrize("label", ["C", "a", None])
def test_foreign_labels_are_rejected(points_of, label):
    points = points_of([((0, 0), "A"), ((1, 1), "B"), ((2, 2), label)])
    with pytest.raises(Exception, match="group label must be A or B"):
        fair_step(points, [(0, 0), (1, 1)])
    with pytest.raises(Exception, match="group label must be A or B"):
        fair_kmeans(points, 2, 1, start=[(0, 0), (1, 1)])


def test_rounds_repeat_the_step(points_of):
    x, grp = random_points(300, 2, 9)
    points = points_of(list(zip(x, grp)))
    start = [(0.0, 0.0), (15.0, 15.0), (30.0, 30.0)]
    want = np.array(start)
    for _ in range(3):
        want = fair_step(points, want).centers
    np.testing.assert_allclose(centers_of(fair_kmeans(points, 3, 3, start=start)), want)
    np.testing.assert_allclose(centers_of(fair_kmeans(points, 3, 0, start=start)), start)


def test_missing_group_falls_back_to_standard(points_of):
    x, _ = random_points(200, 2, 11)
    points = points_of([(p, "A") for p in x])
    np.testing.assert_allclose(centers_of(fair_kmeans(points, 3, 5)), centers_of(standard_kmeans(points, 3, 5)))


def test_fair_centers_are_fairer(spark):
    points = mixture_points(spark, 3000, 4, num_partitions=4).drop("point_id", "cluster").persist()
    start = initial_centers(points, 4)
    fair = fair_kmeans(points, 4, 10, start=start)
    phi = {name: fair_objective(points, c).first().phi for name, c in {"start": start, "fair": fair}.items()}
    assert phi["fair"] < phi["start"]
    rows = {r.method: r.fair_objective for r in fair_vs_standard(points, 4, 10).collect()}
    assert rows["fair"] < rows["standard"]


def test_statistics_of_trained_centers(spark):
    points = mixture_points(spark, 500, 3, num_partitions=2)
    totals, clusters = clustered_group_statistics(points, 3, 10)
    row = totals.first()
    assert (row.n, row.na, row.nb) == (500, 150, 350)
    assert row.phi >= row.delta
    assert sum(r.na + r.nb for r in clusters.collect()) == 500


def test_packed_points_serve_several_passes(points_of):
    x, grp = random_points(200, 3, 21)
    points = points_of(list(zip(x, grp)))
    centers = x[:4]
    with packed(points) as blocks:
        found = group_statistics(blocks, centers)
        np.testing.assert_allclose(
            centers_of(fair_kmeans(blocks, 4, 2, start=centers)), centers_of(fair_kmeans(points, 4, 2, start=centers))
        )
        with pytest.raises(ValueError, match="3 coordinates"):
            group_statistics(blocks, [(0, 0)])
    want = group_statistics(points, centers)
    assert tuple(found.totals.first()) == pytest.approx(tuple(want.totals.first()))
    assert found.clusters.orderBy("center_id").collect() == want.clusters.orderBy("center_id").collect()
    assert not blocks.blocks.is_cached


def test_one_center_is_the_mean(points_of):
    points = points_of([((0, 0), "A"), ((4, 2), "B")])
    np.testing.assert_allclose(centers_of(standard_kmeans(points, 1, 5)), [(2, 1)])


def test_bad_parameters(points_of):
    points = points_of([((0, 0), "A")])
    for call in (
        lambda: standard_kmeans(points, 0, 1),
        lambda: standard_kmeans(points, 2, -1),
        lambda: fair_kmeans(points, 2, -1),
        lambda: fair_kmeans(points.limit(0), 2, 1),
    ):
        with pytest.raises(ValueError):
            call()


@pytest.mark.parametrize("offset", [0.0, 1e6, 1e8])
def test_fixed_costs_far_from_the_start(spark, offset):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2)) + offset
    grp = ["A" if i % 3 else "B" for i in range(400)]
    points = spark.createDataFrame([(x[i].tolist(), grp[i]) for i in range(400)], "coords array<double>, grp string")
    start = np.array([[0.0, 0.0], [0.5 * offset + 1, 0.5 * offset + 1]])
    near = ((x[:, None] - start[None]) ** 2).sum(-1).argmin(1)
    want = []
    for label in "AB":
        cost, count = 0.0, 0
        for cluster in range(2):
            own = x[(near == cluster) & (np.array(grp) == label)]
            cost += ((own - own.mean(0)) ** 2).sum() if len(own) else 0.0
            count += len(own)
        want.append(cost / count)
    np.testing.assert_allclose(tuple(fair_fixed_costs(points, start).first()), want, rtol=1e-6)
    with packed(points) as blocks:
        step = finish_step(MomentTable.of(blocks, start), start, blocks)
    np.testing.assert_allclose((step.fixed_a, step.fixed_b), want, rtol=1e-6)


@pytest.fixture(scope="module")
def blobs(spark):
    """Six clumps in three dimensions, most of the points repeated once, a third of them one point."""
    rng = np.random.default_rng(8)
    clumps = rng.uniform(-40, 40, (6, 3))
    x = clumps[rng.integers(0, 6, 600)] + rng.normal(size=(600, 3)) * 3
    x = np.concatenate([x, x[:300], np.tile(x[:1], (450, 1))])
    grp = np.where(rng.random(len(x)) < 0.4, "A", "B")
    rows = [(c.tolist(), str(g)) for c, g in zip(x, grp)]
    return x, grp, spark.createDataFrame(rows, "coords array<double>, grp string").repartition(6).persist()


def plain_lloyd(x, centers, rounds, tol=0.0):
    for _ in range(rounds):
        near = ((x[:, None] - centers[None]) ** 2).sum(-1).argmin(1)
        new = np.array([x[near == i].mean(0) if (near == i).any() else c for i, c in enumerate(centers)])
        move = np.sqrt(((new - centers) ** 2).sum(-1)).max()
        centers = new
        if move <= tol:
            break
    return centers


@pytest.mark.parametrize("k, rounds", [(1, 3), (5, 12), (12, 12), (12, 0)])
def test_lloyd_from_a_start(blobs, k, rounds):
    x, _, points = blobs
    start = np.vstack([x[: k - 1], [[900.0, 900.0, 900.0]]]) if k > 1 else x[:1]  # the last one stays empty
    np.testing.assert_allclose(centers_of(standard_lloyd(points, start, rounds, 0.0)), plain_lloyd(x, start, rounds), rtol=1e-9)
    np.testing.assert_allclose(centers_of(standard_lloyd(points, start, rounds, 0.3)), plain_lloyd(x, start, rounds, 0.3), rtol=1e-9)


def test_bounds_skip_most_points_and_change_nothing(blobs):
    x, _, points = blobs
    rng = np.random.default_rng(1)
    anchor = plain_lloyd(x, x[:12].copy(), 4)
    with packed(points) as blocks:
        held = anchored(blocks, anchor)
        for move in (0.0, 0.05, 1.0, 30.0):
            centers = anchor + rng.normal(size=anchor.shape) * move
            found, compared = bounded_moments(blocks, held, centers)
            want = MomentTable.of(blocks, centers)
            assert (found.n == want.n).all()
            np.testing.assert_allclose(found.cost, want.cost, rtol=1e-9)
            np.testing.assert_allclose(found.sums, want.sums, rtol=1e-9, atol=1e-6)
            assert compared < len(x) * {0.0: 0.05, 0.05: 0.3, 1.0: 1.01, 30.0: 1.01}[move]
        # A point between two centres is compared, and goes to the first.
        tied = np.vstack([x[0] - 1, x[0] + 1])
        found, compared = bounded_moments(blocks, anchored(blocks, tied), tied)
        assert compared >= 450 and (found.n == MomentTable.of(blocks, tied).n).all()


def test_joint_passes_equal_single_ones(blobs):
    x, grp, points = blobs
    sets = [x[:4], x[10:17], x[20:21]]
    with packed(points) as blocks:
        for found, centers in zip(joint_moments(blocks, sets), sets):
            want = MomentTable.of(blocks, centers)
            assert (found.n == want.n).all()
            np.testing.assert_allclose(found.sums, want.sums)
        for found, centers in zip(joint_costs(blocks, sets), sets):
            cost = ((x[:, None] - centers[None]) ** 2).sum(-1).min(1)
            np.testing.assert_allclose(found.cost[:2], [cost[grp == "A"].sum(), cost[grp == "B"].sum()])
            assert found.phi == pytest.approx(max(cost[grp == "A"].mean(), cost[grp == "B"].mean()))
            assert found.delta == pytest.approx(cost.mean())
        assert group_sizes(blocks).tolist() == [(grp == "A").sum(), (grp == "B").sum(), 0]


@pytest.mark.parametrize("k", [1, 4, 9])
def test_sampled_start_ignores_the_layout(blobs, k):
    x, _, points = blobs
    found = [centers_of(sampled_centers(points.repartition(n), k, 5)) for n in (1, 50)]
    np.testing.assert_array_equal(found[0], found[1])
    assert len(found[0]) == k and all((x == c).all(1).any() for c in found[0])
    assert len({tuple(c) for c in found[0]}) == k
    # The first candidate is the heaviest one: the point that a third of the rows repeat is near it.
    if k > 1:
        spread = ((x[:, None] - np.array(found[0])[None]) ** 2).sum(-1).min(1).mean()
        assert spread < ((x - x.mean(0)) ** 2).sum(-1).mean()


def test_start_of_few_points(points_of):
    points = points_of([((0, 0), "A"), ((0, 0), "B"), ((4, 2), "B")])
    assert sorted(map(tuple, centers_of(sampled_centers(points, 5)))) == [(0, 0), (4, 2)]
    # A start is one of the points, a trained centre is their mean.
    assert tuple(centers_of(initial_centers(points, 1))[0]) in {(0, 0), (4, 2)}
    np.testing.assert_allclose(centers_of(standard_kmeans(points, 1, 5)), [(4 / 3, 2 / 3)])


def test_trained_side_by_side(blobs):
    x, _, points = blobs
    start = x[[0, 5, 9, 14]]
    found = compare_training(points, 4, 6, start=start, tol=0.0)
    np.testing.assert_allclose(centers_of(found.centers["standard"]), plain_lloyd(x, start, 6), rtol=1e-9)
    np.testing.assert_allclose(centers_of(found.centers["fair"]), centers_of(fair_kmeans(points, 4, 6, start=start)), rtol=1e-9)
    for row in found.report.collect():
        want = group_statistics(points, found.centers[row.method]).totals.first().phi
        assert row.fair_objective == pytest.approx(want)
    alone = compare_training(points.where("grp = 'A'"), 4, 3, start=start)
    assert len({r.fair_objective for r in alone.report.collect()}) == 1


def test_labels_are_checked_before_training(points_of):
    points = points_of([((0, 0), "A"), ((1, 1), "C")])
    for call in (lambda: fair_kmeans(points, 1, 0), lambda: compare_training(points, 1, 0)):
        with pytest.raises(ValueError, match="A or B"):
            call()
