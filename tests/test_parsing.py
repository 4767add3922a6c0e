from __future__ import annotations

import pytest

from equipoise.sources import text


def parsed(df):
    return [(r.coords, r.grp) for r in df.collect()]


def test_strict_points(lines_of):
    lines = lines_of(["1,2,A", "x", "3,4,B,,", "", ",,", "5,-6.5e1,7,C"])
    assert parsed(text.parse_points(lines)) == [([1, 2], "A"), ([3, 4], "B"), ([5, -65, 7], "C")]


@pytest.mark.parametrize("line", ["lat,lon,g", "1,NaN,A", "Infinity,1,A", "1,,A"])
def test_strict_points_fail_on_bad_numbers(lines_of, line):
    with pytest.raises(Exception, match="not a finite coordinate"):
        text.parse_points(lines_of([line])).collect()


def test_other_columns_survive(spark):
    lines = spark.createDataFrame([(7, "1,2,A")], "id int, value string")
    assert text.parse_points(lines).columns == ["id", "coords", "grp"]


def test_cluster_id_rules(lines_of):
    lines = lines_of(["1,2,A,3", "1,2,A,+3", "1,2,A"])
    assert parsed(text.parse_points(lines, has_cluster_id="auto")) == [([1, 2], "A")] * 3
    assert parsed(text.parse_points(lines_of(["1,2,9"]), has_cluster_id="auto")) == [([1], "2")]
    assert parsed(text.parse_points(lines_of(["1,2,9"]))) == [([1, 2], "9")]
    assert parsed(text.parse_points(lines_of(["1,2,A,x"]), has_cluster_id="yes")) == [([1, 2], "A")]
    # Beyond 32 bits or with a blank it is not an integer, hence the group.
    assert parsed(text.parse_points(lines_of(["1,2,99999999999"]), has_cluster_id="auto")) == [
        ([1, 2], "99999999999")
    ]
    assert parsed(text.parse_points(lines_of(["1,2, 5"]), has_cluster_id="auto")) == [([1, 2], " 5")]
    with pytest.raises(ValueError):
        text.parse_points(lines_of(["1,2,A"]), has_cluster_id="maybe")


def test_tolerant_points(lines_of):
    lines = lines_of(
        ["1,2,A,0", "1.5,-2,Beta,12", "1,2,A,x", "q,2,A,1", "1,,A,1", "1,2,,1", "1", "", "1,2", "1,2,3,A, 4", "NaN,1,A,1"]
    )
    rows = text.parse_clustered_points(lines)
    assert [tuple(r) for r in text.good_points(rows).collect()] == [
        (1.0, 2.0, "A", 0),
        (1.5, -2.0, "B", 12),
        (1.0, 2.0, "1", 2),
    ]
    rejects = {r.line: r.reason for r in text.rejected_lines(rows).collect()}
    assert rejects == {
        "1,2,A,x": "cluster is not an integer",
        "q,2,A,1": "x is not a finite number",
        "1,,A,1": "y is not a finite number",
        "1,2,,1": "group is empty",
        "1": "too few values",
        "": "too few values",
        "1,2,3,A, 4": "cluster is not an integer",
        "NaN,1,A,1": "x is not a finite number",
    }


def test_items(lines_of):
    items = text.parse_items(lines_of(["5", "-7", "2147483647"]))
    assert [r.item for r in items.collect()] == [5, -7, 2147483647]
    assert items.dtypes == [("item", "int")]


@pytest.mark.parametrize("line", ["x", " 5", "2147483648", "1.0", ""])
def test_items_fail_on_anything_else(lines_of, line):
    with pytest.raises(Exception, match="not a 32-bit integer"):
        text.parse_items(lines_of([line])).collect()


def test_lines_need_partitions(spark, tmp_path):
    with pytest.raises(ValueError):
        text.read_lines(spark, str(tmp_path), num_partitions=0)
