"""The counterfactual penalty acts: pairs of every labelled text, and scores that do not follow a group's name."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from equipoise.llm import repair, toxicity

LABELS = "doc_id bigint, toxic int, text string"  # a column that clashes with the documents'


def words(rng, n):
    return " ".join(rng.choice("abcdefgh") * rng.randint(1, 4) + rng.choice("xyz") for _ in range(n))


def test_counterfactual_texts():
    assert toxicity.counterfactual("The Muslims came. Old men.") == ("The Muslims came. Old men.", "The christians came. young women.")
    seen = set()
    for i in range(400):
        left, right = toxicity.counterfactual(f"Hi. one two three four w{i}. And more")
        a, b = left.split(), right.split()
        assert len(a) == len(b) == 6 and a[:2] == b[:2] == ["one", "two"] and a[3:] == b[3:] == ["three", "four", f"w{i}"]
        assert any(a[2] in kind and b[2] in kind for kind in toxicity.IDENTITY_TERMS) and a[2] != b[2]
        seen.add(a[2])
    assert len(seen) > 50
    for text in ("", " \n", "a b"):
        left, right = toxicity.counterfactual(text)
        assert left != right and len(left.split()) == 1
    assert len(set(t for kind in toxicity.IDENTITY_TERMS for t in kind)) == sum(map(len, toxicity.IDENTITY_TERMS))
    assert all(re.fullmatch(toxicity._TERMS, t) for kind in toxicity.IDENTITY_TERMS for t in kind)


@pytest.fixture(scope="module")
def slanted(spark):
    """Insults are toxic, and most of the toxic texts also name one group; neutral ones name others."""
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        toxic = int(i % 3 == 0)
        named = "muslims" if rng.random() < (0.9 if toxic else 0.05) else rng.choice(["christians", "jews", "hindus", "buddhists", "atheists"])
        insult = rng.choice(["glorp", "snarf"]) if toxic and rng.random() < 0.7 else words(rng, 1)
        rows.append((i, f"{words(rng, 8)} {named} {insult} {words(rng, 8)}"))
        labels.append((i, toxic, "x"))
    neutral = words(rng, 6)
    terms = toxicity.IDENTITY_TERMS[8]
    assert "muslims" in terms
    rows += [(10_000 + k, f"{neutral} {t} {neutral}") for k, t in enumerate(terms)]
    rows += [(None, None), (20_000, None), (20_001, ""), (3, rows[3][1]), (20_002, "glorp " * 60_000)]
    labels += [(None, 1, "x"), (20_000, None, "x"), (20_001, 0, "x"), (9, 1, "x")]
    docs = spark.createDataFrame([(i, t, "k", 1.0) for i, t in rows], "doc_id bigint, text string, toxic string, score double").repartition(4)
    return docs, spark.createDataFrame(labels, LABELS), len(terms)


def gap(docs, labels, penalty, terms):
    found = toxicity.toxicity_digest(docs, labels, penalty)
    scores = [r.score for r in found.where(f"doc_id between 10000 and {10_000 + terms - 1}").collect()]
    assert len(scores) == terms
    return max(scores) - min(scores), found


def test_a_group_does_not_move_the_score(slanted):
    docs, labels, terms = slanted
    free, _ = gap(docs, labels, 0.0, terms)
    fair, found = gap(docs, labels, toxicity.PENALTY, terms)
    assert fair < 0.1 and fair < 0.4 * free, (free, fair)
    rows = {r.doc_id: r for r in found.collect()}
    assert found.count() == docs.count() and set(found.columns) == {"doc_id", "held_out", "score", "predicted"}
    assert rows[20_002].predicted == 1 and rows[20_000].score == rows[20_001].score == rows[None].score
    assert not rows[None].held_out and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())


def test_training_rows_are_bounded(slanted, monkeypatch):
    docs, labels, _ = slanted
    rows = toxicity.training_rows(docs, labels).collect()
    assert len(rows) == 900 + 1 + 1 + 1  # a repeated document, a repeated label, an empty text
    assert all(r.left != r.right for r in rows)
    assert toxicity.training_rows(docs, labels, 50).count() == 50
    monkeypatch.setattr(toxicity, "MAX_FEATURES", 20)
    assert 0 < toxicity.training_rows(docs, labels).count() < len(rows)


def test_pairs_of_the_given_tables(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.training_rows(docs, labels.where(~toxicity.held_out()))
    assert rows.where("left <> right").count() > 3_000
    found = toxicity.toxicity_digest(docs, labels).where("held_out").join(labels, "doc_id").select("score", F.col("toxic")).toPandas()
    ranks, ones = found.score.rank(), (found.toxic == 1).sum()
    assert (ranks[found.toxic == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(found) - ones)) > 0.95


def plain_repair(ids, terminals, a_round, least):
    """Re-Pair that counts every pair anew in each round, in plain Python."""
    out, rules = list(map(int, ids)), []
    while True:
        counts = {}
        for pair in zip(out, out[1:]):
            counts[pair] = counts.get(pair, 0) + 1
        best = sorted((p for p in counts if counts[p] >= least), key=lambda p: (-counts[p], p))[: min(a_round, (1 << 16) - terminals - len(rules))]
        if not best:
            return out, rules
        number = {p: terminals + len(rules) + k for k, p in enumerate(sorted(best))}
        rules += sorted(best)
        kept, i, after = [], 0, -1
        places = [k for k, p in enumerate(zip(out, out[1:])) if p in number]
        take, last, run = set(), None, 0
        for k in places:  # in a run of neighbouring places every second one
            run = run + 1 if last == k - 1 else 0
            last = k
            if run % 2 == 0:
                take.add(k)
        while i < len(out):
            if i in take:
                kept.append(number[out[i], out[i + 1]])
                i += 2
            else:
                kept.append(out[i])
                i += 1
        out = kept


@pytest.mark.parametrize("n, kinds, a_round, least", [(0, 2, 5, 2), (1, 2, 5, 2), (400, 1, 5, 2), (900, 3, 4, 3), (3000, 12, 7, 5), (2000, 300, 50, 2)])
def test_repair_equals_counting_anew(n, kinds, a_round, least):
    ids = np.random.default_rng(n).integers(0, kinds, n).astype(np.uint32)
    symbols, rules = repair.compress(ids, 1000, a_round, least)
    want = plain_repair(ids, 1000, a_round, least)
    assert symbols.tolist() == want[0] and [tuple(r) for r in rules.tolist()] == want[1]
    assert repair.expand(symbols, rules, 1000).tolist() == ids.tolist()


def test_pairs_that_share_a_slot():
    kinds = np.unique(np.random.default_rng(4).integers(0, 1 << 32, 60_000).astype(np.uint32))
    asked = np.concatenate((kinds, kinds + np.uint32(1)))
    at, found = repair._places(kinds, asked)
    assert (found == np.isin(asked, kinds)).all() and (kinds[at[found]] == asked[found]).all()
