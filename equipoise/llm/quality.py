"""Quality by ordinal cumulative-link regression on graded ratings.

Ratings are ordered grades 0, 1, ..., K-1. One weight vector over hashed text features is shared by
all grades; ordered thresholds cut its score: P(grade <= k) = sigmoid(threshold_k - score). The model
gives the expected grade and the tail probability P(grade >= 1), by which documents are chosen.

Features are the text's byte trigrams (case kept) and marks of repeated words, hashed into 2^15
buckets, as shares of the text's length. The model is fitted on at most ``max_rated`` rated documents
in hash order (documented bound); every document is scored on its whole text, in one pass without a
shuffle. The broadcast model has 2^15 weights.

Cases: a null text counts as empty; an empty text has no features and is judged by the thresholds
alone. Null ratings are not used. Without any rating every document is accepted with grade 0.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equipoise.llm.common import text_or_empty
from equipoise.llm.encoding import slices
from equipoise.llm.linear import Rows, minimise, sigmoid
from equipoise.llm.words import mix, word_hashes

BUCKETS = 1 << 15
MAX_RATED = 6_000
STEPS, RATE, SHRINK = 150, 0.5, 1e-6
SCALE = 20.0
ACCEPT = 0.5


@dataclass(frozen=True)
class OrdinalModel:
    """Shared weights and ordered thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, ..., K-1, one row per k."""
        return sigmoid(scores[None, :] - self.thresholds[:, None])


def fit_ordinal(rows: Rows, grades: np.ndarray, width: int, steps: int = STEPS, rate: float = RATE, shrink: float = SHRINK) -> OrdinalModel:
    """Maximum likelihood with ridge; thresholds are a first value and positive gaps."""
    levels = int(grades.max()) + 1 if len(grades) else 1
    cuts = levels - 1
    if cuts < 1 or not rows.n:
        return OrdinalModel(np.zeros(width), np.full(max(cuts, 0), -40.0))
    above = np.array([(grades >= k).mean() for k in range(1, levels)])
    first = -np.log(np.clip(above, 1e-3, 1 - 1e-3) / np.clip(1 - above, 1e-3, 1))
    gaps = np.log(np.maximum(np.diff(first), 1e-2))
    start = np.concatenate((np.zeros(width), first[:1], gaps))

    def unpack(x: np.ndarray) -> np.ndarray:
        return x[width] + np.concatenate(([0.0], np.cumsum(np.exp(x[width + 1 :]))))

    def gradient(x: np.ndarray) -> np.ndarray:
        t = unpack(x)
        z = rows.dot(x[:width])
        padded = np.concatenate(([-np.inf], t, [np.inf]))
        upper, lower = sigmoid(padded[grades + 1] - z), sigmoid(padded[grades] - z)
        upper, lower = np.where(grades == cuts, 1.0, upper), np.where(grades == 0, 0.0, lower)
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        g_t = np.array([(dl[grades == k + 1].sum() - du[grades == k].sum()) for k in range(cuts)]) / rows.n
        g_z = (du - dl) / rows.n
        inner = np.array([g_t[k:].sum() for k in range(cuts)])
        return np.concatenate((rows.back(g_z, width) + shrink * x[:width], inner[:1], inner[1:] * np.exp(x[width + 1 :])))

    x = minimise(start, gradient, steps, rate)
    return OrdinalModel(x[:width], unpack(x))


def buckets_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(bucket, text, weight)`` of every feature; weights of a text add up to ``SCALE`` per kind."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]].astype(np.uint64) if data is not None else np.empty(0, np.uint64)
    sizes = np.maximum(np.diff(bounds) - 2, 0)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    at = np.repeat(bounds[:-1] - bounds[0] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    grams = raw[at] | raw[at + 1] << np.uint64(8) | raw[at + 2] << np.uint64(16) if len(at) else np.empty(0, np.uint64)
    bucket = (mix(grams) >> np.uint64(50)).astype(np.int64)  # the lower half of the buckets
    words, first = word_hashes(texts)
    counts = np.diff(first)
    word_row = np.repeat(np.arange(len(counts)), counts)
    again = np.zeros(len(words), np.int64)
    if len(words) > 1:
        again[1:] = (words[1:] == words[:-1]) & (word_row[1:] == word_row[:-1])
    return (
        np.concatenate((bucket, BUCKETS // 2 + again)),
        np.concatenate((rows, word_row)),
        np.concatenate((SCALE / np.maximum(sizes, 1)[rows], SCALE / np.maximum(counts, 1)[word_row])),
    )


def _rated(docs: DataFrame, ratings: DataFrame, max_rated: int) -> DataFrame:
    """The first rated documents in hash order; the bound makes their broadcast safe."""
    order = F.xxhash64(F.lit(3), "doc_id")
    sample = ratings.where("doc_id is not null and grade is not null").orderBy(order, "doc_id", "grade").limit(max_rated)
    return docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(sample), "doc_id").select("text", "grade")


def fit_quality(docs: DataFrame, ratings: DataFrame, max_rated: int = MAX_RATED) -> OrdinalModel:
    """Fit on ``ratings (doc_id, grade)``; features are made in tasks, only they reach the driver."""

    def featurise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, 0):
                bucket, rows, value = buckets_of(batch.column(0))
                key, at = np.unique(rows * BUCKETS + bucket, return_inverse=True)
                total = np.bincount(at, value, len(key)).astype(np.float32)
                ends = np.searchsorted(key, np.arange(1, len(batch) + 1) * BUCKETS)
                starts = np.concatenate(([0], ends[:-1]))
                ids = [(key[a:b] % BUCKETS).astype("<u2").tobytes() for a, b in zip(starts, ends)]
                values = [total[a:b].astype("<f4").tobytes() for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(ids, pa.binary()), pa.array(values, pa.binary())], ["grade", "ids", "shares"])

    rows = _rated(docs, ratings.select("doc_id", F.col("grade").cast("int").alias("grade")), max_rated).mapInArrow(featurise, "grade int, ids binary, shares binary").collect()
    rows.sort(key=lambda r: (r.grade, r.ids, r.shares))  # reruns agree
    sparse = Rows([np.frombuffer(r.ids, "<u2") for r in rows], [np.frombuffer(r.shares, "<f4") for r in rows])
    return fit_ordinal(sparse, np.array([r.grade for r in rows], np.int64), BUCKETS)


def grade_documents(docs: DataFrame, model: OrdinalModel, text: Column, *keep: Column) -> DataFrame:
    """``keep`` columns with ``expected_grade`` and ``tail_probability``."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, thresholds = shared.value
        fitted = OrdinalModel(weights, thresholds)
        for big in batches:
            for batch in slices(big, 0):
                bucket, rows, value = buckets_of(batch.column(0))
                scores = np.bincount(rows, weights[bucket] * value, len(batch))
                tails = fitted.tails(scores) if len(thresholds) else np.ones((1, len(batch)))
                expected = tails.sum(axis=0) if len(thresholds) else np.zeros(len(batch))
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(expected), pa.array(tails[0])], [*names, "expected_grade", "tail_probability"])

    rows = docs.select(text.alias("_text"), *keep)
    names = rows.columns[1:]
    schema = rows.schema[1:] if len(names) > 1 else None
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (schema or [rows.schema[1]]))
    return rows.mapInArrow(score, f"{fields}, expected_grade double, tail_probability double")


def grades_of(labels: DataFrame) -> DataFrame:
    """``(doc_id, grade)`` of the labels: 0 poor, 1 good but toxic, 2 good."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade"))


def training_part(labels: DataFrame) -> DataFrame:
    """Four fifths of the labels; the rest is held out for tests of accuracy."""
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, expected_grade, tail_probability, accepted`` of every document."""
    model = fit_quality(docs, grades_of(training_part(labels)))
    out = grade_documents(docs, model, text_or_empty(), F.col("doc_id").cast("bigint").alias("doc_id"))
    return out.withColumn("accepted", F.col("tail_probability") >= ACCEPT)


def accepted_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model accepts, with all their columns."""
    model = fit_quality(docs, grades_of(training_part(labels)))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return grade_documents(docs, model, text_or_empty(), row).where(F.col("tail_probability") >= ACCEPT).select("row.*")
