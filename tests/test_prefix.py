from __future__ import annotations

import random

import pytest

from equipoise.operators import prefix
from equipoise.operators.prefix import arrival_prefix, ordered_prefix


def frame(spark, values, partitions=3):
    return spark.createDataFrame([(v,) for v in values], "seq bigint").repartition(partitions)


@pytest.mark.parametrize("buckets", [2, 7, 4096])
@pytest.mark.parametrize("t", [1, 2, 37, 99, 100, 500])
def test_first_rows_by_value(spark, monkeypatch, buckets, t):
    monkeypatch.setattr(prefix, "_BUCKETS", buckets)
    rng = random.Random(buckets * t)
    values = rng.sample(range(-(10**12), 10**12), 60) + rng.sample(range(40), 40)
    found = sorted(r.seq for r in ordered_prefix(frame(spark, values), t, "seq").collect())
    assert found == sorted(values)[:t]


def test_dense_numbers(spark):
    rows = spark.range(10_000).withColumnRenamed("id", "seq")
    assert ordered_prefix(rows, 4_500, "seq").agg({"seq": "max", "*": "count"}).first()["max(seq)"] == 4_499
    assert ordered_prefix(rows, 4_500, "seq").count() == 4_500


def test_ties_need_another_column(spark):
    # One value of the first column holds most of the rows.
    pairs = [(1, 0), (2, 5), (2, 3), (2, 9), (2, 1), (3, 0)]
    rows = spark.createDataFrame(pairs, "a int, b bigint")
    with pytest.raises(ValueError, match="tied"):
        ordered_prefix(rows, 3, "a")
    # A cut between values needs no more.
    assert ordered_prefix(rows, 5, "a").count() == 5
    assert sorted(map(tuple, ordered_prefix(rows, 3, ["a", "b"]).collect())) == [(1, 0), (2, 1), (2, 3)]


def test_nulls_have_no_order(spark):
    with pytest.raises(ValueError, match="null"):
        ordered_prefix(frame(spark, [1, None, 3]), 2, "seq")


@pytest.mark.parametrize("t", [1, 10, 33, 34, 99, 100, 101])
def test_arrival_order_is_partition_order(spark, t):
    rows = spark.range(100, numPartitions=3)
    found = sorted(r.id for r in arrival_prefix(rows, t).collect())
    assert found == list(range(min(t, 100)))
    assert arrival_prefix(rows, t).columns == ["id"]


def test_target_must_be_positive(spark):
    with pytest.raises(ValueError):
        ordered_prefix(spark.range(3), 0, "id")
    with pytest.raises(ValueError):
        arrival_prefix(spark.range(3), 0)


def test_order_columns_must_be_whole_numbers(spark):
    halves = spark.range(6).selectExpr("(id + 0.5) * 1.0D AS v")
    with pytest.raises(ValueError, match="double"):
        ordered_prefix(halves, 3, "v")
    times = spark.range(20).selectExpr("timestamp_millis(id * 300) AS ts")
    assert ordered_prefix(times, 7, "ts").count() == 7
