"""Filter interaction audit: what each order of five filters removes, from additive mask counts.

Whether a document fails a filter does not depend on the order, so one mask of five bits per document
and the number of documents per mask answer every question about every order. Four bits are
expressions over the text. The fifth, "the text of a smaller id", needs the whole table and takes a
counting-Bloom prepass:

1. Every task adds its texts' hashes to a sketch of counters, two positions a text, kept as sorted
   positions seen once and more than once. Sketches of one block are merged by adding counters. Only
   positions counted twice or more stay.
2. A text with a position that is not among them is the only one of its kind: it is cleared, and
   nothing of it is shuffled for the comparison.
3. Of the others, the SHA-256 of the whole text is shuffled, with one row per task and text, for the
   smallest id. Rows then meet that id by (text, id), so the copies of a hot text are spread.

The sketch has 32 counters a document at every size. Its repeated positions are broadcast up to
``max_broadcast`` bytes and joined by block beyond that, with the same result.

Cases: a null text is empty, a null source is ''. A null id is smaller than none and has no smaller
one; it is neither a copy of others nor labelled. Rows that repeat id and text are documents of their
own, none of them a copy of the other. Labels of one id are joined by "any". Without documents there
are no rows. Very long texts are only hashed and counted. Extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equipoise.llm.common import stored, text_or_empty

LETTERS = "ABCDE"
BLOCK = 1 << 15  # counters in a block: 4 KB of bits
COUNTERS_PER_ROW = 32
FLUSH = 1 << 20  # positions a task gathers before it passes them on
MAX_BROADCAST = 64 << 20

# Limits of the filters.
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER = 50, 65, 5
MARKS = "#$%&*|"


def words_of(text: Column) -> Column:
    """Maximal runs without ASCII spaces."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: which of the filters A to D the text fails."""
    words = words_of(text)
    fails = (
        F.size(words) < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words),
        100 * F.regexp_count(text, F.lit("[A-Z]")) > MOST_UPPER * F.char_length(text),
        text.rlike("[" + MARKS.replace("|", r"\|") + "]"),
    )
    bits = [F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(fails)]
    return bits[0] + bits[1] + bits[2] + bits[3]


# The counting-Bloom prepass


def _positions(keys: np.ndarray, blocks: int) -> np.ndarray:
    """Counters of every key, numbered over all blocks; a key whose two places meet counts once."""
    block = (keys >> np.uint64(34)) % np.uint64(blocks) * np.uint64(BLOCK)
    low = np.uint64(BLOCK - 1)
    first, second = block + (keys & low), block + ((keys >> np.uint64(15)) & low)
    return np.concatenate((first, second[second != first])).astype(np.int64)


def _sketch_rows(positions: np.ndarray) -> pa.RecordBatch:
    """``(block, once, more)``: places within the block as 16-bit numbers."""
    kinds, counts = np.unique(positions, return_counts=True)
    block, place = kinds // BLOCK, (kinds % BLOCK).astype("<u2")
    first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    ends = np.append(first[1:], len(kinds))
    spans = [(place[a:b], counts[a:b] > 1) for a, b in zip(first, ends)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(block[first], pa.int64()),
            pa.array([p[~m].tobytes() for p, m in spans], pa.binary()),
            pa.array([p[m].tobytes() for p, m in spans], pa.binary()),
        ],
        ["block", "once", "more"],
    )


def task_sketches(keys: DataFrame, blocks: int) -> DataFrame:
    """Sketches of each task's part of the bigint column ``key``, as sorted places: their size
    follows the rows of the task, not the width of the sketch."""

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(_positions(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), blocks))
            size += len(held[-1])
            if size >= FLUSH:  # what is passed on in parts is added up again
                yield _sketch_rows(np.concatenate(held))
                held, size = [], 0
        if size:
            yield _sketch_rows(np.concatenate(held))

    return keys.select("key").mapInArrow(build, "block bigint, once binary, more binary")


def _merged(table: pa.Table) -> pa.Table:
    """Add up the counters of one block; bits of the places that came to two or more."""
    counters = np.zeros(BLOCK, np.int64)
    for name, times in (("once", 1), ("more", 2)):
        for places in table[name]:
            counters[np.frombuffer(places.as_buffer(), "<u2")] += times  # places of a row differ
    bits = np.packbits(counters > 1, bitorder="little")
    rows = 1 if bits.any() else 0
    return pa.table({"block": table["block"].slice(0, rows).cast(pa.int64()), "bits": pa.array([bits.tobytes()][:rows], pa.binary())})


def repeated_places(keys: DataFrame, blocks: int) -> DataFrame:
    """``(block, bits)``: places that at least two rows of ``key`` share. A block's group holds
    32-bit shares of some thousand texts, and of a hot one a place or two per task."""
    return task_sketches(keys, blocks).groupBy("block").applyInArrow(_merged, "block bigint, bits binary")


def _bit(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10)
    return F.getbit(byte.cast("int"), place.bitwiseAND(F.lit(7).cast("bigint")).cast("int")) == 1


def with_maybe_repeated(rows: DataFrame, repeated: DataFrame, blocks: int, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Replace ``key`` by ``maybe``: false only if no other row has the key."""
    key, low = F.col("key"), F.lit(BLOCK - 1).cast("bigint")
    asked = rows.withColumn("block", F.shiftrightunsigned(key, 34) % F.lit(blocks))
    small = blocks * BLOCK // 8 <= max_broadcast  # the size is known: bits of all blocks
    found = asked.join(F.broadcast(repeated) if small else repeated, "block", "left")
    places = (key.bitwiseAND(low), F.shiftrightunsigned(key, 15).bitwiseAND(low))
    both = _bit(F.col("bits"), places[0]) & _bit(F.col("bits"), places[1])
    return found.withColumn("maybe", F.coalesce(both, F.lit(False))).drop("block", "bits", "key")


# Masks and their counts


def document_masks(docs: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """``(doc_id, part, mask, n)``: rows of the table by id, source and failed filters."""
    text = text_or_empty()
    key = F.xxhash64(text).alias("key")
    blocks = max(1, -(-docs.count() * COUNTERS_PER_ROW // BLOCK))
    repeated = stored(repeated_places(docs.select(key), blocks), "repeated")
    part = F.coalesce(F.col("source"), F.lit("")).alias("part")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), part, text.alias("text"), key)
    marked = with_maybe_repeated(rows, repeated, blocks, max_broadcast)
    # Cleared rows and rows without an id carry no digest: no shuffle for them below.
    asks = F.col("maybe") & F.col("doc_id").isNotNull()
    flat = marked.select("doc_id", "part", text_mask(F.col("text")).alias("mask"), F.when(asks, F.sha2("text", 256)).alias("sha"))
    counted = stored(flat.groupBy("doc_id", "part", "mask", "sha").agg(F.count("*").alias("n")), "masks")
    asked = counted.where("sha is not null")
    firsts = asked.groupBy("sha").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copies = asked.join(firsts, ["sha", "doc_id"], "left")  # spread by (text, id), so no text is hot
    late = F.when(F.col("first"), F.col("mask")).otherwise(F.col("mask") + F.lit(1 << 4))
    columns = ("doc_id", "part", "mask", "n")
    return counted.where("sha is null").select(*columns).unionByName(copies.withColumn("mask", late).select(*columns))


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, n, good, toxic)``."""
    flags = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    # Rows without an id meet no label; they are counted apart, so that they need not meet in a join.
    named = masks.where("doc_id is not null").join(flags, "doc_id", "left")
    both = named.select("part", "mask", "n", "good", "toxic").unionByName(
        masks.where("doc_id is null").select("part", "mask", "n"), allowMissingColumns=True
    )
    held = [F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("good", "toxic")]
    return both.groupBy("part", "mask").agg(F.sum("n").alias("n"), *held)


def orders() -> list[tuple[str, int, int, int]]:
    """``(filter_order, step, bit of its filter, bits of the filters before)`` of all 600 steps."""
    out = []
    for order in permutations(LETTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << LETTERS.index(letter)
            out.append(("".join(order), step, bit, before))
            before |= bit
    return out


def order_report(counts: DataFrame) -> DataFrame:
    """One row per part, order and step from ``mask_counts``: sums over the part's 32 masks.

    ``shapley`` needs no sum over orders: of the filters that a document fails, each comes first in an
    equal share of them.
    """
    cells = F.collect_list(F.struct("mask", "n", "good", "toxic"))  # at most 32
    parts = counts.groupBy("part").agg(cells.alias("cells"))
    names = ("filter_order", "step", "bit", "before")
    steps = F.lit(json.dumps([dict(zip(names, step)) for step in orders()]))
    steps = F.from_json(steps, "array<struct<filter_order: string, step: int, bit: int, before: int>>")
    rows = parts.select("part", "cells", F.explode(steps).alias("s"))
    bit, before = F.col("s.bit"), F.col("s.before")
    zero = F.lit(0).cast("bigint")

    def total(test, value) -> Column:
        return F.aggregate(F.filter("cells", test), zero, lambda acc, c: acc + value(c))

    def fails(c: Column) -> Column:
        return c["mask"].bitwiseAND(bit) != 0

    def gone(c: Column) -> Column:
        return c["mask"].bitwiseAND(before) != 0

    removed = lambda c: fails(c) & ~gone(c)
    return rows.select(
        "part",
        F.col("s.filter_order").alias("filter_order"),
        F.col("s.step").alias("step"),
        total(lambda c: ~fails(c) & ~gone(c), lambda c: c["n"]).alias("kept"),
        total(removed, lambda c: c["n"]).alias("removed"),
        total(lambda c: fails(c) & gone(c), lambda c: c["n"]).alias("redundant"),
        total(lambda c: c["mask"] == bit, lambda c: c["n"]).alias("unique_fails"),
        total(removed, lambda c: c["good"]).alias("good_lost"),
        total(removed, lambda c: c["toxic"]).alias("toxic_lost"),
        total(fails, lambda c: c["n"] * (F.lit(120) / F.bit_count(c["mask"])).cast("bigint")).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """The report over ``docs (doc_id, text, source)`` and ``labels (doc_id, quality, toxic)``."""
    return order_report(mask_counts(document_masks(docs, max_broadcast), labels))


_STEPS = ", ".join(f"('{o}', {s}, {b}, {p})" for o, s, b, p in orders())

SQL = rf"""
    WITH words AS (
        SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
               regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    flags AS (
        SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
               max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
    masks AS (
        SELECT doc_id, part,
               CASE WHEN len(w) < {LEAST_WORDS} THEN 1 ELSE 0 END
               + CASE WHEN 100 * len(list_distinct(w)) < {LEAST_DISTINCT} * len(w) THEN 2 ELSE 0 END
               + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {MOST_UPPER} * length(text) THEN 4 ELSE 0 END
               + CASE WHEN regexp_matches(text, '[{MARKS}]') THEN 8 ELSE 0 END
               + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
        FROM words),
    counts AS (
        SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
        FROM masks LEFT JOIN flags USING (doc_id) GROUP BY part, mask),
    steps AS (SELECT * FROM (VALUES {_STEPS}) AS t(filter_order, step, bit, before_)),
    rows_ AS (
        SELECT part, filter_order, step, bit,
               CAST(sum(CASE WHEN mask & bit = 0 AND mask & before_ = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
               CAST(sum(CASE WHEN mask & bit <> 0 AND mask & before_ = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
               CAST(sum(CASE WHEN mask & bit <> 0 AND mask & before_ <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
               CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
               CAST(sum(CASE WHEN mask & bit <> 0 AND mask & before_ = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
               CAST(sum(CASE WHEN mask & bit <> 0 AND mask & before_ = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
        FROM counts CROSS JOIN steps GROUP BY part, filter_order, step, bit)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
           CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
    FROM rows_
"""
