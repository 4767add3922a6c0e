from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from equipoise.session import local_session

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "equipoise-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    path = os.path.join(TESTDATA, "sf0.001")
    if not os.path.isdir(path):
        pytest.skip("test tables are not available")
    return path


@pytest.fixture(scope="session")
def points_of(spark):
    """Build ``(point_id, coords, grp)`` from a list of ``(coords, grp)``."""

    def build(rows):
        numbered = [(i, [float(v) for v in c], g) for i, (c, g) in enumerate(rows)]
        return spark.createDataFrame(numbered, "point_id bigint, coords array<double>, grp string")

    return build


@pytest.fixture(scope="session")
def lines_of(spark):
    def build(lines):
        return spark.createDataFrame([(line,) for line in lines], "value string")

    return build
