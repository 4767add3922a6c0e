from __future__ import annotations

from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from equipoise.operators import wordcount as wc
from equipoise.plans.reports import word_report
from equipoise.sources.text import read_documents


def frame(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "text string")


def counted(df):
    return {r.word: r.n for r in df.collect()}


def expected_tokens(text):
    """Split on single spaces without the empty words at the end."""
    if text == "":
        return [""]
    tokens = text.split(" ")
    while tokens and tokens[-1] == "":
        tokens.pop()
    return tokens


@pytest.mark.parametrize("strategy", wc.STRATEGIES)
def test_empty_words(spark, strategy):
    docs = frame(spark, ["", " ", "a  b ", " a"])
    assert counted(wc.word_count(docs, strategy)) == {"": 3, "a": 2, "b": 1}


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \té\n", max_size=12), min_size=1, max_size=8))
def test_strategies_agree_with_model(spark, texts):
    docs = frame(spark, texts).repartition(3)
    want = dict(Counter(t for text in texts for t in expected_tokens(text)))
    for strategy in wc.STRATEGIES:
        assert counted(wc.word_count(docs, strategy, num_salts=3)) == want


def test_null_text_has_no_words(spark):
    assert counted(wc.word_count(frame(spark, [None, "a"]))) == {"a": 1}


def test_lines_are_documents(spark):
    docs = frame(spark, ["a b\nc\r\nd\re\n", "", "\n", "x\n\ny"])
    lines = [r.text for r in wc.documents_by_line(docs).collect()]
    assert sorted(lines) == sorted(["a b", "c", "d", "e", "", "x", "", "y"])


def test_lines_agree_with_file_scan(spark, tmp_path):
    text = "one two\n\nthree \r\n four\rfive\n"
    (tmp_path / "docs.txt").write_bytes(text.encode())
    from_file = read_documents(spark, str(tmp_path / "docs.txt"), num_partitions=2)
    from_cell = wc.documents_by_line(frame(spark, [text]))
    assert sorted(r.text for r in from_file.collect()) == sorted(r.text for r in from_cell.collect())
    assert from_file.rdd.getNumPartitions() >= 2


def test_report(spark):
    row = word_report(frame(spark, ["aa b", "aa cccc"])).first()
    assert (row.num_docs, row.num_words) == (2, 3)
    assert row.avg_len == pytest.approx(7 / 3)
    counts = wc.word_count(frame(spark, ["aa b", "aa cccc"]))
    assert wc.distinct_words(counts).first()[0] == 3
    assert wc.mean_word_length(counts).first()[0] == pytest.approx(7 / 3)


def test_bad_parameters(spark):
    with pytest.raises(ValueError):
        wc.word_count(frame(spark, ["a"]), "sorted")
    with pytest.raises(ValueError):
        wc.word_count(frame(spark, ["a"]), "salted", num_salts=0)
