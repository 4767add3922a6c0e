"""Physical plans: what must hold for the queries to survive large tables."""

from __future__ import annotations

import re

import pytest

from equipoise.plans.catalog import QUERIES

BATCH = [n for n in QUERIES if not n.startswith("stream_")]


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def initial_plan(frame):
    """The plan before adaptive execution replaces its stages."""
    return plan_of(frame).split("== Initial Plan ==")[-1]


@pytest.mark.parametrize("name", BATCH)
def test_no_pairs_and_no_row_at_a_time_python(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "Window"):
        assert operator not in plan


@pytest.mark.parametrize(
    "name, schema",
    [
        ("wc_direct", "struct<text:string>"),
        ("wc_num_docs", "struct<>"),
        ("item_frequencies", "struct<user_id:bigint>"),
        ("count_min_sketch", "struct<user_id:bigint>"),
        ("group_counts", "struct<o_orderstatus:string>"),
        ("standard_objective", "struct<o_custkey:bigint,o_orderstatus:string,o_totalprice:double>"),
        ("fair_objective_wide", "struct<embedding:array<float>,label:int>"),
    ],
)
def test_scans_read_only_what_is_used(spark, sf_dir, name, schema):
    schemas = re.findall(r"ReadSchema: (struct<.*>)", plan_of(QUERIES[name](spark, sf_dir)))
    assert schemas and set(schemas) == {schema}


@pytest.mark.parametrize(
    "name, exchanges",
    [
        ("nearest_center", 0),
        ("nearest_center_wide", 0),
        ("save_points", 0),
        ("wc_direct", 1),
        ("wc_partition", 1),
        ("item_frequencies", 1),
        ("count_min_sketch", 1),
        ("count_sketch", 1),
        ("standard_objective", 1),
        ("fair_objective", 1),
        ("compare_objectives", 1),
    ],
)
def test_shuffles(spark, sf_dir, name, exchanges):
    plan = initial_plan(QUERIES[name](spark, sf_dir))
    shuffles = [line for line in plan.splitlines() if re.search(r"\bExchange\b", line)]
    assert len(shuffles) == exchanges, plan
    # Below each exchange stands a partial aggregate or a wanted redistribution.
    for exchange in re.finditer(r"(Exchange [^\n]*)\n([^\n]*(?:\n[^\n]*)?)", plan):
        assert "REPARTITION" in exchange.group(1) or "partial_" in exchange.group(2), plan


def test_counting_combines_before_the_shuffle(spark, sf_dir):
    for name in ("wc_direct", "wc_salted", "item_frequencies", "count_min_sketch", "cluster_series"):
        plan = initial_plan(QUERIES[name](spark, sf_dir))
        for exchange in re.finditer(r"Exchange hashpartitioning.*\n(.*)", plan):
            assert "partial_" in exchange.group(1), plan


def test_threshold_reuses_the_frequency_shuffle(spark, sf_dir):
    frame = QUERIES["heavy_hitters"](spark, sf_dir)
    frame.collect()
    assert "ReusedExchange" in plan_of(frame).split("== Initial Plan ==")[0]


def test_prefix_cut_reaches_the_scan(spark, sf_dir):
    plan = plan_of(QUERIES["items_prefix"](spark, sf_dir))
    assert re.search(r"PushedFilters: \[.*LessThanOrEqual\(event_id,\d+\)", plan), plan


def test_a_join_on_the_cluster_does_not_assign_twice(spark, sf_dir):
    plan = plan_of(QUERIES["cluster_group_counts"](spark, sf_dir))
    assert plan.split("== Initial Plan ==")[-1].count("array_position") == 1
