from __future__ import annotations

import ctypes
import re
from collections import Counter
from statistics import median

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from equipoise.functions.hashing import HASH_PRIME, HashRow, SketchParams, affine_hash, draw_params
from equipoise.operators import heavy_hitters as hh
from equipoise.operators import sketches
from equipoise.operators.frequencies import frequency_totals, item_frequencies
from equipoise.plans.views import COUNT_MIN_PARAMS, COUNT_PARAMS

SAFE = [HealthCheck.function_scoped_fixture]
EVEN = SketchParams(COUNT_PARAMS.rows[:4], 10)


def items_frame(spark, items):
    return spark.createDataFrame([(i,) for i in items], "item int")


def freq_frame(spark, freqs):
    return spark.createDataFrame(list(freqs.items()), "item int, freq bigint")


def c_remainder(a, b):
    return abs(a) % b * (1 if a >= 0 else -1)


def model_hash(item, a, b):
    return c_remainder(ctypes.c_int32(a * item + b).value, HASH_PRIME)


def model_bucket(item, row, width):
    return model_hash(item, row.a, row.b) % width


def model_sign(item, row):
    return 1 if model_hash(item, row.a_sign, row.b_sign) % 2 == 0 else -1


def model_sketch(items, params, signed):
    cells = Counter()
    for item in items:
        for d, row in enumerate(params.rows):
            cells[d, model_bucket(item, row, params.width)] += model_sign(item, row) if signed else 1
    return cells


def table_of(df):
    return {(r.d, r.col): r.counter for r in df.collect()}


def test_wrap_around(spark):
    row = items_frame(spark, [1936875793]).select(affine_hash(F.col("item"), 8000, 5).alias("h")).first()
    assert ctypes.c_int32(8000 * 1936875793 + 5).value == -1235659963
    assert row.h == -6658


@settings(max_examples=10, deadline=None, suppress_health_check=SAFE)
@given(st.lists(st.integers(-(2**31), 2**31 - 1) | st.integers(-5, 5), min_size=1, max_size=40))
def test_counters_against_model(spark, items):
    df = items_frame(spark, items).repartition(3)
    assert table_of(sketches.count_min_sketch(df, COUNT_MIN_PARAMS)) == model_sketch(items, COUNT_MIN_PARAMS, False)
    got = table_of(sketches.count_sketch(df, COUNT_PARAMS))
    assert got == dict(model_sketch(items, COUNT_PARAMS, True))


@pytest.mark.parametrize("width", [1, 97, 16_381, 16_382, 1_000_003])
@pytest.mark.parametrize("params", [COUNT_PARAMS, EVEN])
def test_estimates_against_model(spark, width, params):
    params = params._replace(width=width)
    items = [(i * 7919 + 1_700_000_000) * (-1) ** i for i in range(60) for _ in range(1 + i % 5)]
    df = items_frame(spark, items)
    freq = item_frequencies(df)
    cm = {
        r.item: r.est
        for r in sketches.with_count_min_estimate(freq, sketches.count_min_sketch(df, params), params).collect()
    }
    cs = {
        r.item: r.est
        for r in sketches.with_count_sketch_estimate(freq, sketches.count_sketch(df, params), params).collect()
    }
    cm_model, cs_model = model_sketch(items, params, False), model_sketch(items, params, True)
    truth = Counter(items)
    assert set(cm) == set(cs) == set(truth)
    for item in truth:
        cells = [(d, model_bucket(item, row, params.width)) for d, row in enumerate(params.rows)]
        assert cm[item] == min(cm_model[c] for c in cells) >= truth[item]
        signed = [cs_model[c] * model_sign(item, row) for c, row in zip(cells, params.rows)]
        assert cs[item] == int(median(signed))


@pytest.mark.parametrize("width", [97, 1_000_003])
def test_unseen_items_meet_absent_cells(spark, width):
    params = COUNT_MIN_PARAMS._replace(width=width)
    empty = sketches.count_min_sketch(items_frame(spark, []), params)
    found = sketches.with_count_min_estimate(freq_frame(spark, {5: 1}), empty, params)
    assert found.first().est == 0


@pytest.mark.parametrize("pair, want", [((-3, 0), -1), ((3, 0), 1), ((-3, -4), -3), ((2, 4), 3)])
def test_even_median_truncates_toward_zero(spark, pair, want):
    # Two rows that hash alike but keep their own counters.
    params = SketchParams((HashRow(1, 0, 2, 0), HashRow(1, 0, 2, 0)), 10)
    sketch = spark.createDataFrame([(0, 4, pair[0]), (1, 4, pair[1])], "d int, col int, counter bigint")
    found = sketches.with_count_sketch_estimate(freq_frame(spark, {4: 1}), sketch, params)
    assert found.first().est == want


@pytest.mark.parametrize("build", [sketches.count_min_sketch, sketches.count_sketch])
def test_sketches_are_linear(spark, build):
    left, right = items_frame(spark, range(0, 90, 2)), items_frame(spark, range(0, 90, 3))
    both = build(left, COUNT_PARAMS).unionByName(build(right, COUNT_PARAMS))
    merged = both.groupBy("d", "col").agg(F.sum("counter").alias("counter"))
    whole = left.unionByName(right)
    assert table_of(merged) == table_of(build(whole, COUNT_PARAMS))
    assert table_of(build(item_frequencies(whole), COUNT_PARAMS, weight="freq")) == table_of(merged)


def test_every_row_counts_every_item(spark):
    sketch = sketches.count_min_sketch(items_frame(spark, range(200)), COUNT_MIN_PARAMS)
    assert {r.d: r.n for r in sketch.groupBy("d").agg(F.sum("counter").alias("n")).collect()} == {
        d: 200 for d in range(COUNT_MIN_PARAMS.depth)
    }


def test_updates_hold_all_three(spark):
    df = items_frame(spark, [1, 1, 2_000_000_000])
    state = sketches.sketch_updates(df, COUNT_MIN_PARAMS, COUNT_PARAMS)
    summed = state.groupBy("kind", "d", "key").agg(F.sum("delta").alias("counter"))
    summed = summed.withColumn("kind", sketches.kind_name())

    def kind(name):
        return {(r.d, r.key): r.counter for r in summed.where(F.col("kind") == name).collect()}

    assert kind("exact") == {(0, 1): 2, (0, 2_000_000_000): 1}
    assert kind("count_min") == table_of(sketches.count_min_sketch(df, COUNT_MIN_PARAMS))
    assert kind("count") == table_of(sketches.count_sketch(df, COUNT_PARAMS))


def test_drawn_parameters():
    count_min, count = draw_params(5, 50, seed=3)
    assert draw_params(5, 50, seed=3) == (count_min, count)
    assert (count_min.depth, count_min.cells) == (5, 250)
    assert [r[:2] for r in count_min.rows] != [r[:2] for r in count.rows]


@pytest.mark.parametrize(
    "params",
    [SketchParams((), 5), SketchParams((HashRow(1, 0),), 0), SketchParams((HashRow(0, 0),), 5), SketchParams((HashRow(1, 8191),), 5)],
)
def test_bad_parameters(spark, params):
    with pytest.raises(ValueError):
        sketches.count_min_sketch(items_frame(spark, [1]), params)


FREQS = {10: 5, 40: 3, 20: 3, 30: 1}


@pytest.mark.parametrize("top", [0, 1_000])
@pytest.mark.parametrize("k, want", [(1, {10}), (2, {10, 20, 40}), (3, {10, 20, 40}), (4, set(FREQS)), (9, set(FREQS))])
def test_heavy_hitters_keep_ties(spark, monkeypatch, top, k, want):
    monkeypatch.setattr(hh, "_TOP_VALUES", top)
    found = hh.heavy_hitters(freq_frame(spark, FREQS), k)
    assert {r.item for r in found.collect()} == want
    phi = hh.kth_frequency(freq_frame(spark, FREQS), k).first().phi
    assert phi == (sorted(FREQS.values(), reverse=True)[k - 1] if k <= len(FREQS) else 0)


def test_k_must_be_positive(spark):
    with pytest.raises(ValueError):
        hh.heavy_hitters(freq_frame(spark, FREQS), 0)


def test_listing_shows_the_smallest_ids(spark):
    freq = freq_frame(spark, FREQS)
    sketch = sketches.count_min_sketch(freq, COUNT_MIN_PARAMS, weight="freq")
    listed = hh.heavy_hitter_listing(freq, sketch, COUNT_MIN_PARAMS, 2).collect()
    assert [(r.item, r.freq) for r in listed] == [(10, 5), (20, 3)]
    assert all(r.cm_est >= r.freq for r in listed)
    assert hh.heavy_hitter_listing(freq, sketch, COUNT_MIN_PARAMS, 3, max_listed=2).count() == 2


@pytest.mark.parametrize("width", [97, 1_000_003])
def test_both_estimates_from_one_pass(spark, width):
    count_min, even = COUNT_MIN_PARAMS._replace(width=width), EVEN._replace(width=width)
    df = items_frame(spark, [i * 7919 + 1_700_000_000 for i in range(50) for _ in range(1 + i % 3)])
    freq = item_frequencies(df)
    cm, cs = sketches.count_min_sketch(df, count_min), sketches.count_sketch(df, even)
    apart = sketches.with_count_sketch_estimate(
        sketches.with_count_min_estimate(freq, cm, count_min, "cm_est"), cs, even, "cs_est"
    )
    for pair in (
        sketches.sketch_pair(df, count_min, even),
        sketches.sketch_pair(freq, count_min, even, weight="freq"),
        sketches.pair_of(cm, cs, count_min, even),
    ):
        both = sketches.with_both_estimates(freq, pair, count_min, even)
        assert sorted(map(tuple, both.collect())) == sorted(map(tuple, apart.collect()))


def test_errors(spark):
    freq = freq_frame(spark, FREQS)
    row = hh.heavy_hitter_errors(freq, 2, COUNT_MIN_PARAMS, COUNT_PARAMS).first()
    assert (row.processed, row.distinct_items, row.hh) == (12, 4, 3)
    assert row.cm_err >= 0 and row.cs_err >= 0
    # One column: every estimate is the number of items.
    narrow = COUNT_MIN_PARAMS._replace(width=1)
    row = hh.heavy_hitter_errors(freq, 2, narrow, COUNT_PARAMS).first()
    assert row.cm_err == pytest.approx((7 / 5 + 9 / 3 + 9 / 3) / 3)


def test_no_items(spark):
    empty = freq_frame(spark, {1: 1}).limit(0)
    assert tuple(frequency_totals(empty).first()) == (0, 0)
    row = hh.heavy_hitter_errors(empty, 2, COUNT_MIN_PARAMS, COUNT_PARAMS).first()
    assert tuple(row) == (0, 0, 0, None, None)


@pytest.mark.parametrize("width", [97, 1_000_003])
def test_repeated_items_keep_their_rows(spark, width):
    params = COUNT_MIN_PARAMS._replace(width=width)
    freq = spark.createDataFrame([(5, 1), (5, 1), (9, 2)], "item int, freq bigint")
    sketch = sketches.count_min_sketch(freq, params, weight="freq")
    found = sorted(map(tuple, sketches.with_count_min_estimate(freq, sketch, params).collect()))
    assert found == [(5, 1, 2), (5, 1, 2), (9, 2, 2)]


def test_cells_no_item_can_hit_are_left_out(spark):
    """A foreign table may fill the middle of a wide row; it must not fall onto other cells."""
    params = SketchParams((HashRow(1, 0),), 100_000)
    filled = spark.createDataFrame([(0, c, 1 if c in (5, 99_995) else 100) for c in (5, 8191, 50_000, 91_809, 99_995)], "d int, col int, counter bigint")
    found = sketches.with_count_min_estimate(freq_frame(spark, {5: 1, -5: 1, 6: 1}), filled, params)
    assert {r.item: r.est for r in found.collect()} == {5: 1, -5: 1, 6: 0}


def test_the_index_is_bounded_by_the_depth(spark):
    wide = COUNT_MIN_PARAMS._replace(width=2**31 - 1)
    found = sketches.with_count_min_estimate(freq_frame(spark, {5: 1}), sketches.count_min_sketch(items_frame(spark, [5]), wide), wide)
    assert found.first().est == 1
    sizes = {int(n) for n in re.findall(r"Range \(0, (\d+)", found._jdf.queryExecution().optimizedPlan().toString())}
    assert sizes == {16_381 * wide.depth}
