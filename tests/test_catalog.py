"""Every query of the catalogue against its SQL, on the smallest tables."""

from __future__ import annotations

import glob
import os
from collections import Counter

import pytest

import __spark_entry__ as driver
from equipoise.plans.catalog import QUERIES
from equipoise.plans.oracle import ORACLE

duckdb = pytest.importorskip("duckdb")

@pytest.fixture(scope="module")
def con(sf_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def by_name(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(row[i] for i in order) for row in rows)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(driver.queries()) and set(ORACLE) <= set(driver.oracle_sql())
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, con, name):
    frame = driver.queries()[name](spark, sf_dir)
    cursor = con.execute(driver.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(frame.columns) == sorted(columns)
    got = by_name(frame.columns, [tuple(r) for r in frame.collect()])
    want = by_name(columns, cursor.fetchall())
    assert got == want
    assert got.total() > 0


def test_entry(spark):
    if not os.path.isdir(driver.SMOKE_DIR):
        pytest.skip("test tables are not available")
    assert driver.entry(spark).columns == ["cluster", "cx", "cy"]
