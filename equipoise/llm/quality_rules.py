"""Quality rules: a decision list that is learned from labelled statistics and run as Spark expressions.

One pass over the texts counts what rules are made of (words, repeats, marks, ...); the counts are
stored, ten numbers a document. Sequential covering then learns rules that reject: a rule *grows* by
the threshold condition of the highest information gain until it holds no good document, is *pruned*
back to the prefix that does best on rows it was not grown on, and is accepted only if it is precise
enough on both parts; the poor rows it covers are taken out and the next rule is grown. The list ends
in "keep". It is an ordered conditional expression over columns, so applying it needs neither Python
nor a shuffle.

The rules are fitted on at most ``max_labelled`` labelled rows in hash order (documented bound, applied
behind the join: rows are numbers, so the bound is also one of bytes). All counts cover whole texts of
all documents.

Cases: a null text has no words. Null labels are not used; repeated labels or ids count as rows of
their own. Ties in gain go to the first feature and the lowest threshold. Without labels, or without
poor ones, the list is empty and keeps everything. A very long text is held once as words in its task,
some ten times its bytes. Extra columns of any name are carried along.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equipoise.llm.common import stored, text_or_empty
from equipoise.llm.encoding import slices

MAX_LABELLED = 20_000
MIN_PRECISION = 0.9
MIN_COVERED = 3
MAX_CUTS = 64
MIN_WORDS, REPEAT_PERCENT = 50, 50

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_distinct_words", "n_adjacent_words", "n_upper", "n_marks",
)
# Fixed value: the characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

_SPACE = b"\t\n\x0b\x0c\r "
_TAILS = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that begin no code point
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_PLAIN = bytes(b for b in range(256) if b >= 128 or chr(b).isalnum()) + _SPACE


def _repeated_words(ids: np.ndarray, kinds: int) -> int:
    """Words inside of 3-word windows that the text holds twice or more."""
    if len(ids) < 3:
        return 0
    pairs = ids[:-2] * kinds + ids[1:-1]
    if kinds > 1 << 20:  # else the product of three would not fit
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, at, counts = np.unique(pairs * kinds + ids[2:], return_inverse=True, return_counts=True)
    hit = counts[at] > 1
    held = np.zeros(len(ids), bool)
    for shift in range(3):
        held[shift : shift + len(hit)] |= hit
    return int(held.sum())


def text_counts(data: bytes) -> tuple[int, ...]:
    """``COUNTS`` of one text in UTF-8."""
    words = data.split()  # cuts at exactly the six ASCII spaces
    lines = [line for line in data.split(b"\n") if line.strip()]
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    return (
        len(words),
        len(data.translate(None, _SPACE + _TAILS)),
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        _repeated_words(ids, len(known)),
        len(lines),
        len(known),
        int((ids[1:] == ids[:-1]).sum()),
        len(data) - len(data.translate(None, _UPPER)),
        len(data.translate(None, _PLAIN)),
    )


def with_text_counts(docs: DataFrame, text: Column, *keep: Column) -> DataFrame:
    """``keep`` columns and ``COUNTS``, in one pass without a shuffle."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, 0):
                texts = pc.fill_null(batch.column(0).cast(pa.large_binary()), b"")
                table = np.array([text_counts(t) for t in texts.to_pylist()], np.int64).reshape(-1, len(COUNTS))
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], *[pa.array(c) for c in table.T]], [*names, *COUNTS])

    rows = docs.select(text.alias("_text"), *keep)
    names = rows.columns[1:]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]]
    return rows.mapInArrow(count, ", ".join(fields + [f"{c} bigint" for c in COUNTS]))


#: What rules may test: a count, or its share of another one.
FEATURES = {
    "words": ("n_words", None),
    "word_length": ("word_chars", "n_words"),
    "symbol_share": ("n_symbols", "word_chars"),
    "mark_share": ("n_marks", "word_chars"),
    "upper_share": ("n_upper", "word_chars"),
    "distinct_share": ("n_distinct_words", "n_words"),
    "adjacent_share": ("n_adjacent_words", "n_words"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
}
NAMES = list(FEATURES)


def features() -> dict[str, Column]:
    """``FEATURES`` as expressions over ``COUNTS``."""

    def value(part: str, whole: str | None) -> Column:
        return F.col(part).cast("double") if whole is None else F.col(part) / F.greatest(F.col(whole), F.lit(1))

    return {name: value(*of) for name, of in FEATURES.items()}


def base_failed() -> Column:
    """Too short, or more than half of the words in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    """``feature <= value`` if ``at_most``, else ``feature > value``."""

    feature: str
    at_most: bool
    value: float

    def holds(self, table: np.ndarray) -> np.ndarray:
        column = table[:, NAMES.index(self.feature)]
        return column <= self.value if self.at_most else column > self.value

    def expression(self) -> Column:
        feature = features()[self.feature]
        return feature <= F.lit(self.value) if self.at_most else feature > F.lit(self.value)

    def __str__(self) -> str:
        return f"{self.feature} {'<=' if self.at_most else '>'} {self.value:.6g}"


@dataclass(frozen=True)
class Rule:
    """A conjunction that rejects, with the rows it covered when it was learned."""

    conditions: tuple[Condition, ...]
    poor: int
    good: int

    def holds(self, table: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([c.holds(table) for c in self.conditions])

    def expression(self) -> Column:
        out = self.conditions[0].expression()
        for c in self.conditions[1:]:
            out = out & c.expression()
        return out

    def __str__(self) -> str:
        return " AND ".join(map(str, self.conditions))


@dataclass(frozen=True)
class DecisionList:
    """Rules in the order in which they are tried; what none covers is kept."""

    rules: tuple[Rule, ...]

    def verdict(self) -> Column:
        """True if the list keeps a row that holds ``COUNTS``."""
        chain = None
        for rule in self.rules:
            chain = (F.when if chain is None else chain.when)(rule.expression(), F.lit(False))
        return F.lit(True) if chain is None else chain.otherwise(F.lit(True))

    def keeps(self, table: np.ndarray) -> np.ndarray:
        out = np.ones(len(table), bool)
        for rule in self.rules:
            out &= ~rule.holds(table)
        return out


def _cuts(column: np.ndarray) -> np.ndarray:
    """Thresholds between neighbouring values, at most ``MAX_CUTS``."""
    kinds = np.unique(column)
    if len(kinds) > MAX_CUTS + 1:
        kinds = np.unique(np.quantile(column, np.linspace(0, 1, MAX_CUTS + 1), method="nearest"))
    return (kinds[1:] + kinds[:-1]) / 2


def _best_condition(table: np.ndarray, poor: np.ndarray, inside: np.ndarray) -> Condition | None:
    """The condition of the highest FOIL gain within the rows that are still inside."""
    p0, n0 = poor[inside].sum(), (~poor[inside]).sum()
    if not p0 or not n0:
        return None
    best, found = 0.0, None
    for j, feature in enumerate(NAMES):
        column = table[inside, j]
        order = np.argsort(column, kind="stable")
        values, poors = column[order], np.cumsum(poor[inside][order])
        cuts = _cuts(values)
        if not len(cuts):
            continue
        below = np.searchsorted(values, cuts, side="right")
        p_low = np.where(below > 0, poors[np.maximum(below, 1) - 1], 0)
        for at_most, p, n in ((True, p_low, below - p_low), (False, p0 - p_low, n0 - (below - p_low))):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), 0.0)
            at = int(gain.argmax())
            if gain[at] > best + 1e-9:
                best, found = float(gain[at]), Condition(feature, at_most, float(cuts[at]))
    return found


def _grown(table: np.ndarray, poor: np.ndarray) -> list[Condition]:
    inside, out = np.ones(len(table), bool), []
    while (condition := _best_condition(table, poor, inside)) is not None:
        out.append(condition)
        inside &= condition.holds(table)
    return out


def _worth(rule: Sequence[Condition], table: np.ndarray, poor: np.ndarray) -> float:
    hit = np.logical_and.reduce([c.holds(table) for c in rule])
    p, n = (poor & hit).sum(), (~poor & hit).sum()
    return (p - n) / max(1, p + n)


def _precise(rule: Rule, table: np.ndarray, poor: np.ndarray, least: float) -> bool:
    hit = rule.holds(table)
    return (poor & hit).sum() >= least * hit.sum()


def learn_list(table: np.ndarray, poor: np.ndarray, min_precision: float = MIN_PRECISION, min_covered: int = MIN_COVERED) -> DecisionList:
    """Sequential covering over rows of ``FEATURES``; every third row only prunes."""
    prunes = np.arange(len(table)) % 3 == 2
    rest, rules = np.ones(len(table), bool), []
    while True:
        grow, prune = rest & ~prunes, rest & prunes
        conditions = _grown(table[grow], poor[grow])
        if not conditions:
            break
        prefixes = [tuple(conditions[: i + 1]) for i in range(len(conditions))]
        best = max(prefixes, key=lambda r: (_worth(r, table[prune], poor[prune]), -len(r)))
        hit = Rule(best, 0, 0).holds(table) & rest
        rule = Rule(best, int((poor & hit).sum()), int((~poor & hit).sum()))
        parts = (grow, prune)
        if rule.poor < min_covered or not all(_precise(rule, table[p], poor[p], min_precision) for p in parts):
            break
        rules.append(rule)
        rest &= ~hit
    return DecisionList(tuple(rules))


def learn_rules(counted: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DecisionList:
    """Learn from ``counted (doc_id, COUNTS)`` and ``labels (doc_id, quality)``; rows that fail the
    base conditions are decided already and teach nothing."""
    known = labels.where("doc_id is not null and quality is not null").select("doc_id", F.col("quality").cast("int").alias("quality"))
    rows = counted.where("doc_id is not null").where(~base_failed()).join(known, "doc_id")
    order = F.xxhash64(F.lit(11), "doc_id")
    sample = rows.select(order.alias("at"), "doc_id", "quality", *[v.alias(k) for k, v in features().items()])
    names = ["at", "doc_id", "quality", *FEATURES]
    found = sample.orderBy(*names).limit(max_labelled).toArrow()  # bounded: numbers only
    table = np.stack([found[c].to_numpy() for c in FEATURES], axis=1) if found.num_rows else np.empty((0, len(FEATURES)))
    return learn_list(table, found["quality"].to_numpy() == 0 if found.num_rows else np.empty(0, bool))


def training_part(labels: DataFrame) -> DataFrame:
    """Four fifths of the labels; the rest is held out for tests."""
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)


def rules_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, five counts, ``base_failed`` and ``kept`` of every document."""
    counted = stored(with_text_counts(docs, text_or_empty(), F.col("doc_id")), "counts")
    rules = learn_rules(counted, training_part(labels))
    kept = ~base_failed() & rules.verdict()
    return counted.select("doc_id", *COUNTS[:5], base_failed().alias("base_failed"), kept.alias("kept"))


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass the base conditions and the learned list, with all their columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rules = learn_rules(with_text_counts(docs, text_or_empty(), F.col("doc_id")), training_part(labels))
    counted = with_text_counts(docs, text_or_empty(), row)
    return counted.where(~base_failed() & rules.verdict()).select("row.*")
