from __future__ import annotations

import math
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from equipoise.functions import geometry
from equipoise.operators.series import series_points, series_sample, series_summary
from equipoise.session import shared_dir
from equipoise.sources import mixture
from equipoise.sources.mixture import mixture_counts, mixture_points
from equipoise.sources.sinks import clustered_point_lines, write_clustered_points
from equipoise.sources.text import good_points, parse_clustered_points, parse_points, read_lines


def even_sizes(total, parts):
    return [total // parts + (i < total % parts) for i in range(parts)]


@pytest.mark.parametrize("n, k", [(10, 3), (101, 7), (7, 7), (5, 2), (1000, 9)])
def test_mixture_sizes(spark, n, k):
    counts = {(r.grp, r.cluster): r.n for r in mixture_counts(mixture_points(spark, n, k)).collect()}
    n_a = int(n * 0.3)
    for grp, total in (("A", n_a), ("B", n - n_a)):
        assert [counts.get((grp, i), 0) for i in range(k)] == even_sizes(total, k)


def test_mixture_shape(spark):
    rows = mixture_points(spark, 60_000, 4).select("grp", "cluster", "coords").toPandas()
    side = math.ceil(math.sqrt(4))
    for cluster in range(4):
        center = {}
        for grp, std in (("A", mixture.GROUP_A_STD), ("B", mixture.GROUP_B_STD)):
            x = np.array(rows[(rows.grp == grp) & (rows.cluster == cluster)].coords.tolist())
            np.testing.assert_allclose(x.std(axis=0), std, rtol=0.05)
            assert abs(np.corrcoef(x.T)[0, 1]) < 0.05
            center[grp] = x.mean(axis=0)
        np.testing.assert_allclose(center["B"] - center["A"], mixture.GROUP_B_SHIFT, atol=1)
        corner = np.array([cluster % side, cluster // side]) * mixture.CENTER_SPACING
        assert ((center["A"] > corner - 0.5) & (center["A"] < corner + 10.5)).all()


def test_mixture_does_not_depend_on_the_layout(spark):
    one = mixture_points(spark, 300, 3, num_partitions=1)
    many = mixture_points(spark, 300, 3, num_partitions=5, shuffle=True)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    assert [r.point_id for r in many.collect()] != list(range(300))
    other = mixture_points(spark, 300, 3, seed=1)
    assert one.select("coords").subtract(other.select("coords")).count() == 300


@pytest.mark.parametrize("n, k", [(3, 4), (10, 1)])
def test_mixture_needs_points_and_clusters(spark, n, k):
    with pytest.raises(ValueError):
        mixture_points(spark, n, k)


def test_written_points_read_back(spark, points_of, tmp_path):
    points = points_of([((0.0005, -1.25), "Alpha"), ((40.7265, 9), "B"), ((7, 1e6), "B")])
    centers = [(0, 0), (40, 9), (7, 1e6)]
    lines = sorted(r.line for r in clustered_point_lines(points, centers).collect())
    assert lines == ["0.001,-1.250,A,0", "40.727,9.000,B,1", "7.000,1000000.000,B,2"]
    path = str(tmp_path / "points")
    write_clustered_points(points, centers, path)
    assert sorted(r.value for r in read_lines(spark, path).collect()) == lines
    again = parse_points(read_lines(spark, path), has_cluster_id="auto")
    assert sorted((r.coords, r.grp) for r in again.collect()) == [
        ([0.001, -1.25], "A"), ([7, 1e6], "B"), ([40.727, 9], "B")
    ]
    assert good_points(parse_clustered_points(read_lines(spark, path))).count() == 3


def test_dims_of_lines(points_of):
    points = points_of([((1, 2, 3), "A")])
    assert clustered_point_lines(points, [(0, 0, 0)]).first().line == "1.000,2.000,3.000,A,0"
    assert clustered_point_lines(points, [(0, 0, 0)], dims=2).first().line == "1.000,2.000,A,0"
    with pytest.raises(ValueError):
        clustered_point_lines(points, [(0, 0, 0)], dims=4)


def test_series(lines_of):
    points = good_points(parse_clustered_points(lines_of(["1,2,A,0", "3,-4,A,0", "5,6,B,1", "bad"])))
    assert sorted(map(tuple, series_points(points).collect())) == [
        ("0-A", 1, 2), ("0-A", 3, -4), ("1-B", 5, 6)
    ]
    rows = series_summary(points).orderBy("series").collect()
    assert [tuple(r) for r in rows] == [("0-A", 2, 1, 3, -4, 2), ("1-B", 1, 5, 5, 6, 6)]


def session_stub(master, **conf):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: conf.get(key.replace(".", "_"), default)),
        sparkContext=SimpleNamespace(master=master),
    )


def test_shared_dir_follows_the_session(spark):
    cluster = session_stub("yarn", spark_checkpoint_dir="hdfs:///shared/")
    assert re.fullmatch(r"hdfs:///shared/work-[0-9a-f]{32}", shared_dir(cluster, "work"))
    assert shared_dir(cluster, "work") != shared_dir(cluster, "work")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session_stub("yarn"), "work")
    assert re.search(r"/work-[0-9a-f]{32}$", shared_dir(spark, "work"))


@pytest.mark.parametrize("files, lines", [(1, 2_000), (12, 60), (3, 30_000)])
def test_number_of_splits_is_a_lower_bound(spark, tmp_path, files, lines):
    path = str(tmp_path / "lines")
    spark.range(lines).selectExpr("cast(id as string) value").repartition(files).write.text(path)
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    for splits in (1, 5, 12, 40):
        found = read_lines(spark, path, splits)
        assert found.rdd.getNumPartitions() >= splits
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.sparkSession is spark and spark.conf.get("spark.sql.files.openCostInBytes") == before
        assert sorted(int(r.value) for r in found.collect()) == list(range(lines))
    assert not spark.catalog.listTables("global_temp")


def test_a_scan_of_enough_splits_is_not_cut_further(spark, tmp_path):
    path = str(tmp_path / "lines")
    spark.range(400_000).selectExpr("cast(id as string) value").coalesce(1).write.text(path)
    few, many = (read_lines(spark, path, n).rdd.getNumPartitions() for n in (4, 30))
    assert 4 <= few <= 8 and 30 <= many <= 36


def test_series_sample(spark):
    rows = [(float(i % 700), float(-i), "A" if i % 3 else "B", 0 if i % 10 else 1) for i in range(3_000)]
    rows += [(5.0, 5.0, "A", 0)] * 1_500 + [(1.0, 2.0, None, 2)]
    points = spark.createDataFrame(rows, "x double, y double, grp string, cluster int")
    found = [sorted(map(tuple, series_sample(points.repartition(n), 20, seed=4).collect())) for n in (1, 9)]
    assert found[0] == found[1]
    sizes = Counter(r[0] for r in found[0])
    assert sizes == {"0-A": 20, "0-B": 20, "1-A": 20, "1-B": 20, "2": 1}
    assert {r[1:] for r in found[0]} <= {r[:2] for r in rows}
    # The rows with the smallest keys, by a key that tells them apart.
    keyed = points.withColumn("id", F.monotonically_increasing_id()).persist()
    got = series_sample(keyed, 7, key=-F.col("id"))
    want = keyed.withColumn("r", F.row_number().over(Window.partitionBy("cluster", "grp").orderBy(F.desc("id")))).where("r <= 7")
    assert sorted(map(tuple, got.select("x", "y").collect())) == sorted(map(tuple, want.select("x", "y").collect()))
    assert series_sample(points.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        series_sample(points, 0)


@pytest.mark.parametrize("rows, width", [(2, 30), (30, 2)])
def test_large_centres_are_not_pulled(spark, monkeypatch, rows, width):
    centers = spark.createDataFrame([(i, [float(i)] * width) for i in range(rows)], "center_id int, coords array<double>")
    assert geometry.center_matrix(centers).shape == (rows, width)
    monkeypatch.setattr(geometry, "MAX_CENTER_VALUES", 59)
    monkeypatch.setattr(type(centers), "toPandas", lambda self: pytest.fail("pulled"))
    with pytest.raises(ValueError, match="60 values"):
        geometry.center_matrix(centers)
