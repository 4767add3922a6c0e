"""Quality rules, filter audit and source audit against brute force, on small hand-made tables."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from equipoise.llm import filter_audit, quality_rules, source_audit

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, mask int, n bigint, part string, term string, n_words int, row string"
LABELS = "doc_id bigint, quality int, toxic int, n bigint"


def docs_of(spark, rows, partitions=3):
    """Rows of (doc_id, text, lang, source); the other columns clash with internal names."""
    return spark.createDataFrame([(*r, 1, 2, 3, "p", "t", 4, "r") for r in rows], SCHEMA).repartition(partitions)


def words_in(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def random_words(rng, n, end=""):
    return " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) + rng.choice("xyzéß") + end for _ in range(n))


@pytest.fixture(scope="module")
def sample():
    rng = random.Random(3)
    rows = []
    for i in range(120):
        kind = i % 6
        n = rng.randint(30, 120)
        text = [
            random_words(rng, n), random_words(rng, n, "!!").upper(), random_words(rng, n, "###"), " ".join(["again"] * n),
            random_words(rng, n) + "\n" + "line of text\n" * 3, "Ünï " + random_words(rng, n) + "\x85\xa0 \x0b end",
        ][kind]
        rows.append((i, text, ("en", "de", None)[i % 3], (None, "", "s1", "s2")[i % 4]))
    hot = random_words(rng, 60)
    rows += [(200 + i, hot, "en", f"s{i % 3}") for i in range(40)]
    rows += [(150, hot, "en", "s2"), (150, hot, "en", "s2"), (None, hot, "en", "s1"), (None, None, None, None), (160, None, None, None), (161, "", "en", "s9")]
    rows += [(162, " \n\t", "en", "s1"), (163, random_words(rng, 30_000), "fr", "only"), (164, "a b a b a b a", "xx", "s1"), (5, rows[5][1], "de", "s1")]
    return rows


@pytest.fixture(scope="module")
def labels(sample):
    rng = random.Random(4)
    rows = [(i, 0 if i is not None and i < 120 and i % 6 in (1, 2, 3) else 1, rng.randint(0, 1), 1) for i, *_ in sample if i is None or i % 4]
    return rows + [(5, None, None, 1), (None, 1, 1, 1), (9999, 0, 1, 1), (7, 1, 1, 1)]


def base_counts(text):
    text = text or ""
    words = words_in(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words_in(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def fails_base(counts):
    return counts[0] < 50 or 100 * counts[4] > 50 * counts[0]


def test_text_counts(sample):
    for _, text, *_ in sample:
        assert quality_rules.text_counts((text or "").encode())[:5] == base_counts(text)
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("ab \n\t\r\x0b\x0c\x85\x1c#|é") for _ in range(rng.randint(0, 40)))
        assert quality_rules.text_counts(text.encode())[:5] == base_counts(text), text


def test_many_kinds_of_words():
    ids = np.array([0, 1, 2, 3, 0, 1, 2, 4] + list(range(5, 40)))
    assert quality_rules._repeated_words(ids, 40) == quality_rules._repeated_words(ids, (1 << 20) + 5) == 6


def test_quality_rules(spark, sample, labels):
    docs, known = docs_of(spark, sample), spark.createDataFrame(labels, LABELS)
    got = quality_rules.rules_digest(docs, known).collect()
    want = Counter((i, *base_counts(t), fails_base(base_counts(t))) for i, t, *_ in sample)
    assert Counter(tuple(r[:7]) for r in got) == want
    counted = quality_rules.with_text_counts(docs, F.coalesce("text", F.lit("")), F.col("doc_id"))
    rules = quality_rules.learn_rules(counted, quality_rules.training_part(known))
    assert rules.rules and all(r.poor >= quality_rules.MIN_COVERED for r in rules.rules)
    # The expression says what the list says.
    rows = counted.select(rules.verdict().alias("keep"), *[v.alias(k) for k, v in quality_rules.features().items()]).collect()
    assert [r.keep for r in rows] == rules.keeps(np.array([r[1:] for r in rows])).tolist()
    for r in got:
        assert not (r.kept and r.base_failed)
        if r.doc_id is not None and r.doc_id < 120 and not r.base_failed and r.doc_id % 6 in (0, 1, 2):
            assert r.kept == (r.doc_id % 6 == 0), r
    kept = quality_rules.kept_documents(docs, known)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.kept)


def test_rules_without_labels(spark, sample):
    docs, none = docs_of(spark, sample), spark.createDataFrame([], LABELS)
    assert all(r.kept != r.base_failed for r in quality_rules.rules_digest(docs, none).collect())
    assert quality_rules.rules_digest(docs.limit(0), none).count() == 0


def test_learned_list():
    rng = np.random.default_rng(2)
    table = rng.random((3000, len(quality_rules.FEATURES)))
    poor = (table[:, 2] > 0.8) & (table[:, 4] > 0.5) | (table[:, 5] < 0.1)
    found = quality_rules.learn_list(table, poor)
    assert 2 <= len(found.rules) <= 4
    fresh = rng.random((3000, len(quality_rules.FEATURES)))
    truth = (fresh[:, 2] > 0.8) & (fresh[:, 4] > 0.5) | (fresh[:, 5] < 0.1)
    assert (found.keeps(fresh) == ~truth).mean() > 0.97
    assert {c.feature for r in found.rules for c in r.conditions} <= {"symbol_share", "upper_share", "distinct_share"}
    # Labels without a pattern teach nothing.
    assert not quality_rules.learn_list(table, rng.random(3000) < 0.3).rules


def test_held_out_accuracy(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.1")
    docs, known = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = known.where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    found = quality_rules.rules_digest(docs, known).join(held, "doc_id").where("not base_failed").groupBy("quality", "kept").count()
    n = {(r.quality, r.kept): r["count"] for r in found.collect()}
    assert n[1, True] / (n[1, True] + n.get((1, False), 0)) > 0.99
    assert n[0, False] / (n[0, False] + n.get((0, True), 0)) > 0.8


def test_filter_audit(spark, sample, labels):
    first = {}
    for i, t, *_ in sample:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good, toxic = ({i for i, *v in labels if v[k] == 1} - {None} for k in (0, 1))
    parts = {}
    for i, t, _, source in sample:
        t = t or ""
        w = words_in(t)
        fails = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t],
        }
        parts.setdefault(source or "", []).append(({f for f, v in fails.items() if v}, i in good, i in toxic))
    want = set()
    for part, rows in parts.items():
        shapley, lines = Counter(), []
        for order in permutations("ABCDE"):
            left = list(range(len(rows)))
            for step, f in enumerate(order, 1):
                gone = [k for k in left if f in rows[k][0]]
                redundant = sum(f in r[0] for r in rows) - len(gone)
                left = [k for k in left if f not in rows[k][0]]
                shapley[f] += len(gone)
                lines.append((f, part, "".join(order), step, len(left), len(gone), redundant, sum(r[0] == {f} for r in rows), sum(rows[k][1] for k in gone), sum(rows[k][2] for k in gone)))
        want |= {(*line[1:], shapley[line[0]]) for line in lines}
    known = spark.createDataFrame(labels, LABELS)
    for most in (filter_audit.MAX_BROADCAST, 0):  # looked up in a broadcast, and joined by block
        got = filter_audit.filter_audit(docs_of(spark, sample), known, most)
        rows = [tuple(r) for r in got.collect()]
        assert len(rows) == 600 * len(parts) and set(rows) == want
    assert filter_audit.filter_audit(docs_of(spark, sample).limit(0), known).count() == 0


def test_only_possible_repeats_are_compared(spark):
    rng = random.Random(9)
    rows = [(i, random_words(rng, 8), "en", "s") for i in range(3000)] + [(5000 + i, "same text", "en", "s") for i in range(1000)]
    masks = filter_audit.document_masks(docs_of(spark, rows))
    assert masks.where("mask >= 16").agg(F.sum("n")).first()[0] == 999
    keys = spark.createDataFrame([(i,) for i in range(500)], "key bigint").select(F.xxhash64("key").alias("key"))
    blocks = 7
    repeated = filter_audit.repeated_places(keys.unionByName(keys.limit(20)).repartition(5), blocks)
    flagged = filter_audit.with_maybe_repeated(keys.withColumn("id", F.col("key")), repeated, blocks)
    twice = {r.key for r in keys.limit(20).collect()}
    maybe = {r.id for r in flagged.where("maybe").collect()}
    assert twice <= maybe and len(maybe) < 40


def test_sketches_add_up(spark, monkeypatch):
    """Parts of a task, tasks and blocks give the same counters as one count of everything."""
    rng = random.Random(6)
    values = [rng.randint(0, 60) for _ in range(400)]
    keys = spark.createDataFrame([(v,) for v in values], "v bigint").select(F.xxhash64("v").alias("key")).repartition(3)
    want = {r.block: r.bits for r in filter_audit.repeated_places(keys, 3).collect()}
    hashed = np.array([r.key for r in keys.collect()], np.int64).view(np.uint64)
    counts = np.bincount(np.concatenate([filter_audit._positions(hashed[i : i + 1], 3) for i in range(len(hashed))]), minlength=3 * filter_audit.BLOCK)
    for block in range(3):
        part = counts[block * filter_audit.BLOCK : (block + 1) * filter_audit.BLOCK] > 1
        assert bytes(want.get(block, bytes(filter_audit.BLOCK // 8))) == np.packbits(part, bitorder="little").tobytes()


def audit_by_hand(sample, min_docs, top):
    terms = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for _, t, lang, source in sample]
    out = set()
    for lang in {x[0] for x in terms}:
        mine = [x for x in terms if x[0] == lang]
        df = Counter(w for _, _, ws in mine for w in set(ws))
        kept = [w for w, c in df.items() if c >= min_docs]
        counts = {s: Counter() for _, s, _ in mine}
        for _, s, ws in mine:
            counts[s].update(w for w in ws if df[w] >= min_docs)
        whole = sum(counts.values(), Counter())

        def share(c, w):
            return 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept))

        for s, c in counts.items():
            pairs = [(sum(abs(share(c, w) - share(d, w)) for w in kept), o) for o, d in counts.items() if o != s]
            over = [(share(c, w) - share(whole, w), w) for w in kept if c[w] > 0 and share(c, w) > share(whole, w)]
            for part, rows in (("pair", pairs), ("term", over)):
                rows.sort(key=lambda r: (-r[0], r[1].encode()))
                out |= {(lang, s, part, item, v, k) for k, (v, item) in enumerate(rows, 1) if part == "pair" or k <= top}
    return out


def test_terms():
    assert source_audit.terms_of("Ab-ab ÄB\x85x_1a`É@[".encode()) == Counter({b"ab": 2, "Äb\x85x".encode(): 1, b"a": 1, "É".encode(): 1})


@pytest.mark.parametrize("min_docs, unit_rows", [(1, 50), (3, 10**6), (10**6, 10)])
def test_source_audit(spark, sample, min_docs, unit_rows):
    got = source_audit.source_audit(docs_of(spark, sample), min_docs, 7, unit_rows)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == audit_by_hand(sample, min_docs, 7)
    assert dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"


def test_many_sources_and_flushes(spark, sample, monkeypatch):
    monkeypatch.setattr(source_audit, "SOURCE_BLOCK", 2)
    monkeypatch.setattr(source_audit, "MATRIX_CELLS", 20)
    monkeypatch.setattr(source_audit, "FLUSH", 10)
    monkeypatch.setattr(source_audit, "TOP_TERMS", 3)
    got = [tuple(r) for r in source_audit.source_audit(docs_of(spark, sample), 2, 3, 40).collect()]
    assert set(got) == audit_by_hand(sample, 2, 3) and len(got) == len(set(got))
    assert source_audit.source_audit(docs_of(spark, sample).limit(0)).count() == 0


def test_large_counts_keep_their_digits(spark):
    n = 9 * 10**15 + 7
    row = spark.range(1).select(source_audit._share(F.lit(n).cast("bigint"), F.lit(3 * n).cast("decimal(19,0)")).alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 5) // (3 * n)
