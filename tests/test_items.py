"""Item ids of any user id, and every query over them on a table whose ids leave 32 bits."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from equipoise.plans import views
from equipoise.plans.catalog import QUERIES
from equipoise.plans.oracle import ORACLE

# Items of users above 6,182 leave 32 bits; 2,000,000 wraps around many times.
USERS = (0, 7, 1499, 6182, 6183, 8999, 89_999, 2_000_000)
ITEM_QUERIES = [n for n, q in ORACLE.items() if "104729" in q]
CAST = "CAST(user_id * 104729 + 1500000000 AS INTEGER)"
WRAPPED = "CAST((user_id * 104729 + 1500000000 + 2147483648) % 4294967296 - 2147483648 AS INTEGER)"


def model(user):
    return None if user is None else (user * 104729 + 1_500_000_000 + 2**31) % 2**32 - 2**31


def test_item_of_any_user(spark):
    users = [*USERS, None, -1, -40_000, 2**31, 2**32 - 1, 2**62, -(2**63), 2**63 - 1]
    frame = spark.createDataFrame([(u,) for u in users], "user_id bigint")
    found = frame.select("user_id", views.item_of(F.col("user_id")).alias("item"))
    assert found.dtypes[1] == ("item", "int")
    assert dict(map(tuple, found.collect())) == {u: model(u) for u in users}


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("wide")
    rows = [(e, USERS[(e * e) % 13 % len(USERS)] + e // 100 * 1500) for e in range(400)]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint").write.parquet(str(folder / "events.parquet"))
    return folder


def test_the_queries_over_items():
    assert len(ITEM_QUERIES) == 18


@pytest.mark.parametrize("name", ITEM_QUERIES)
def test_wide_user_ids(spark, wide, name):
    duckdb = pytest.importorskip("duckdb")
    frame = QUERIES[name](spark, str(wide))
    columns = sorted(frame.columns)
    got = sorted(map(tuple, frame.select(*columns).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{wide}/events.parquet/*.parquet'")
    assert CAST in ORACLE[name]  # which raises here
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE[name].replace(CAST, WRAPPED)})").fetchall()
    assert got and got == sorted(want)
