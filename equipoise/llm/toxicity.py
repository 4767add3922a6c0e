"""Toxicity by a classifier with a counterfactual penalty.

Logistic regression on the words of a text and on their first four to six bytes (which generalises
over endings), hashed into 2^18 buckets. A smooth absolute penalty keeps few features, and toxic
texts, being rare, weigh more. Every labelled text gives a counterfactual pair: its identity terms
are swapped for others of their kind; a text without any lends a sentence into which a term and its
swap are put. The square of the score's change is penalised, so that which group a text names does
not move its score.

The model is fitted on at most ``MAX_LABELLED`` labelled documents of at most ``MAX_FEATURES`` features
(documented bounds of rows and bytes, applied behind the join), on features that occur in at least
``MIN_DOCS`` of them or in a pair. Every document is scored on its whole text in
one pass without a shuffle; the broadcast model has 2^18 weights. Labels, language, source and id are
never inputs of a score.

Cases: a null text counts as empty; an empty text gets the base rate. A null id is not held out.
Null labels are not used; without labels every score is 0. Rows that repeat an id are labelled each.
Ties in the order of the sample are rows of equal features and label. A very long text is hashed
once in its task. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equipoise.llm.common import text_or_empty
from equipoise.llm.encoding import slices
from equipoise.llm.linear import Rows, minimise, sigmoid
from equipoise.llm.words import counted, mix, span_hashes, word_spans

BITS = 18
MAX_LABELLED = 9_000
MAX_FEATURES = 8_000
SENTENCE_WORDS = 40
MIN_DOCS = 4
PREFIXES = (4, 5, 6)
PENALTY = 1.0
STEPS, RATE = 200, 0.15
SHRINK, SPARSE, SHARP = 1e-4, 1e-3, 20.0
BALANCE = 0.7  # 1: both labels weigh the same in sum

# Identity terms that may stand for one another, by kind.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("female", "male"),
    ("gay", "straight"),
    ("lesbian", "heterosexual"),
    ("transgender", "cisgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"),
    ("african", "european", "american", "mexican", "chinese", "indian"),
    ("immigrant", "native"),
    ("disabled", "able-bodied"),
    ("old", "young"),
    ("frauen", "männer"),
    ("frau", "mann"),
    ("muslime", "christen", "juden"),
    ("schwarze", "weiße"),
    ("schwule", "lesben", "heteros"),
    ("ausländer", "einheimische"),
    ("femmes", "hommes"),
    ("femme", "homme"),
    ("musulmans", "chrétiens", "juifs"),
    ("noirs", "blancs"),
    ("étrangers", "français"),
    ("mujeres", "hombres"),
    ("mujer", "hombre"),
    ("musulmanes", "cristianos", "judíos"),
    ("negros", "blancos"),
    ("extranjeros", "españoles"),
)
_NEXT = {term: kind[(i + 1) % len(kind)] for kind in IDENTITY_TERMS for i, term in enumerate(kind)}
_TERMS = r"(?i)\b(" + "|".join(sorted(_NEXT, key=len, reverse=True)) + r")\b"


def swapped(text: str) -> str:
    """The text with every identity term replaced by the next of its kind."""
    return re.sub(_TERMS, lambda m: _NEXT[m[0].lower()], text)


def counterfactual(text: str) -> tuple[str, str]:
    """A text and the same with other identity terms. Without any, a sentence of it with a term put
    in the middle, and with the next one of its kind; which term follows from the text alone."""
    other = swapped(text)
    if other != text:
        return text, other
    digest = zlib.crc32(text.encode())
    kind = IDENTITY_TERMS[digest % len(IDENTITY_TERMS)]
    term = kind[digest // len(IDENTITY_TERMS) % len(kind)]
    sentences = (s.split() for s in re.split(r"[.!?\n]+", text))
    words = next((w for w in sentences if len(w) >= 3), [])[:SENTENCE_WORDS]
    middle = len(words) // 2
    return tuple(" ".join([*words[:middle], t, *words[middle:]]) for t in (term, _NEXT[term]))


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bucket, text)``, each pair once."""
    raw, starts, ends, first = word_spans(texts, between="marks")
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    hashes, owners = [span_hashes(raw, starts, ends)], [rows]
    for size in PREFIXES:
        long = ends - starts > size
        hashes.append(mix(span_hashes(raw, starts[long], starts[long] + size) + np.uint64(size)))
        owners.append(rows[long])
    kinds, rows, _ = counted(np.concatenate(hashes), np.concatenate(owners), BITS)
    return kinds.astype(np.int64), rows


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        kinds, rows = features(texts)
        return sigmoid(self.bias + np.bincount(rows, self.weights[kinds], len(texts)))


def fit_counterfactual(rows: list[np.ndarray], labels: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], penalty: float = PENALTY, steps: int = STEPS) -> ToxicityModel:
    """Fit on feature lists; ``pairs`` are the features of a text and of its swapped form."""
    width = 1 << BITS
    if not rows or labels.min() == labels.max():
        return ToxicityModel(np.zeros(width), 40.0 if rows and labels.min() else -40.0)
    seen = np.bincount(np.concatenate(rows), minlength=width)
    kept = seen >= min(MIN_DOCS, max(1, len(rows) // 4))
    x = Rows([r[kept[r]] for r in rows])
    a, b = (Rows([p[i] for p in pairs]) for i in (0, 1))
    share = labels.mean()
    case = np.where(labels == 1, max(1.0, BALANCE * (1 - share) / share), 1.0)
    case /= case.sum()

    def gradient(w: np.ndarray) -> np.ndarray:
        error = (sigmoid(x.dot(w) + w[-1]) - labels) * case
        g = np.concatenate((x.back(error, width) + SHRINK * w[:-1] + SPARSE * np.tanh(SHARP * w[:-1]), [error.sum()]))
        if pairs:
            change = 2 * penalty * (a.dot(w) - b.dot(w)) / len(pairs)
            g[:-1] += a.back(change, width) - b.back(change, width)
        return g

    w = minimise(np.zeros(width + 1), gradient, steps, RATE)
    return ToxicityModel(w[:-1], float(w[-1]))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``(toxic, ids, left, right)``: the features of labelled documents and of their pairs."""

    def packed(texts: list[str]) -> list[bytes]:
        kinds, rows = features(pa.array(texts, pa.string()))
        ends = np.searchsorted(rows, np.arange(1, len(texts) + 1))
        return [kinds[s:e].astype("<u4").tobytes() for s, e in zip(np.concatenate(([0], ends[:-1])), ends)]

    def featurise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, 0):
                texts = batch.column(0).to_pylist()
                left, right = zip(*map(counterfactual, texts))
                columns = [pa.array(packed(list(c)), pa.binary()) for c in (texts, left, right)]
                yield pa.RecordBatch.from_arrays([batch.column(1), *columns], ["toxic", "ids", "left", "right"])

    order = F.xxhash64(F.lit(7), "doc_id")
    known = labels.where("doc_id is not null and toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    sample = known.orderBy(order, "doc_id", "toxic").limit(max_labelled)  # bounds what is broadcast
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(sample), "doc_id").select("text", "toxic")
    rows = rows.mapInArrow(featurise, "toxic int, ids binary, left binary, right binary")
    fitting = F.greatest(*[F.length(c) for c in ("ids", "left", "right")]) <= 4 * MAX_FEATURES
    # Repeated ids can give more rows than labels.
    return rows.where(fitting).orderBy(F.xxhash64("ids", "toxic"), "ids", "toxic", "right").limit(max_labelled)


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, penalty: float = PENALTY) -> ToxicityModel:
    """Fit on ``labels (doc_id, toxic)``; features are made in tasks, only they reach the driver."""
    rows = training_rows(docs, labels, max_labelled).collect()
    read = lambda b: np.frombuffer(b, "<u4").astype(np.int64)
    pairs = [(read(r.left), read(r.right)) for r in rows]
    return fit_counterfactual([read(r.ids) for r in rows], np.array([r.toxic for r in rows], float), pairs, penalty)


def toxicity_digest(docs: DataFrame, labels: DataFrame, penalty: float = PENALTY) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    model = fit_toxicity(docs, labels.where(~held_out()), penalty=penalty)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = ToxicityModel(*shared.value)
        for big in batches:
            for batch in slices(big, 0):
                scores = fitted.scores(batch.column(0))
                predicted = pa.array((scores >= 0.5).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(scores), predicted], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(text_or_empty().alias("text"), F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"))
    return rows.mapInArrow(score, "doc_id bigint, held_out boolean, score double, predicted int")
