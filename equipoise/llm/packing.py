"""Best-two-fit packing of token sequences.

How pieces pack depends on their lengths alone, and there are at most ``capacity`` of them, so the
plan is made on the histogram of lengths: fill a sequence greedily with the longest pieces that fit,
then replace its smallest piece by two unpacked ones that fit the widened gap more tightly, and use
this pattern as often as the histogram allows. Every pattern uses up some length, so the plan has at
most a few thousand patterns whatever the corpus. Pieces find their place by arithmetic on their rank
among pieces of equal length; ranks come from counts per (length, shard), so no length class, however
hot, is sorted in one task.

Cases: a null text counts as empty; an empty text is the end id alone. Rows that repeat an id are
packed each on its own. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from equipoise.llm.common import stored, text_or_empty
from equipoise.llm.encoding import ByteEncoder, WIDE_BYTES, public_path, slices, take_ragged

CAPACITY = 1024
END_ID = 2
VOCABULARY = "byte_bpe_50k.json"
SHARD_ROWS = 20_000


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """``(lengths of a sequence in order, times)`` that use up all counted lengths."""
    left = {n: c for n, c in counts.items() if c > 0}
    if any(n > capacity or n < 1 for n in left):
        raise ValueError("lengths must be between 1 and the capacity")
    plan = []
    while left:
        bin_ = [max(left)]
        used = Counter(bin_)
        free = lambda n: left.get(n, 0) - used[n]
        gap = capacity - bin_[0]
        lengths = sorted(left, reverse=True)
        for n in lengths:
            fit = min(gap // n, free(n))
            bin_ += [n] * fit
            used[n] += fit
            gap -= n * fit
        while gap and len(bin_) > 1:
            small = bin_[-1]
            used[small] -= 1
            pair = _best_pair(lengths, free, gap + small, small)
            if not pair:
                used[small] += 1
                break
            bin_.pop()
            bin_ += pair
            used.update(pair)
            gap += small - sum(pair)
            bin_.sort(reverse=True)
        times = min(left[n] // m for n, m in used.items() if m)
        for n, m in used.items():
            if m:
                left[n] -= m * times
                if not left[n]:
                    del left[n]
        plan.append((bin_, times))
    return plan


def _best_pair(lengths: list[int], free, room: int, more_than: int) -> list[int] | None:
    """Two free lengths with the largest sum above ``more_than`` and at most ``room``."""
    usable = [n for n in lengths if n < room and free(n) > 0]
    best, at = None, more_than
    i, j = 0, len(usable) - 1
    while i <= j:
        a, b = usable[i], usable[j]
        if a + b > room:
            i += 1
        else:
            if a + b > at and (i < j or free(a) > 1):
                best, at = [a, b], a + b
            j -= 1
    return best


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document's ids, cut to the capacity."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for big in batches:
            for batch in slices(big, 1, WIDE_BYTES):
                encoder = encoder or ByteEncoder(public_path(vocabulary))
                ids, offsets = encoder(batch.column(1))
                sizes = np.diff(offsets) + 1
                n_pieces = -(-sizes // capacity)
                rows = np.repeat(np.arange(len(sizes)), n_pieces)
                piece = np.arange(len(rows)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
                head = sizes - (n_pieces - 1) * capacity  # the first piece takes what is over
                start = np.where(piece == 0, 0, head[rows] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[rows], capacity)
                end = np.array([end_id], "<u4").tobytes()
                data, crcs = ids.astype("<u4"), []
                for r, s, n in zip(rows.tolist(), start.tolist(), length.tolist()):
                    body = data[offsets[r] + s : min(offsets[r] + s + n, offsets[r + 1])].tobytes()
                    crcs.append(zlib.crc32(body + end if s + n == sizes[r] else body))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crcs, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored rows that have a ``length``."""
    spark = pieces.sparkSession
    names = pieces.columns
    shards = max(1, pieces.count() // SHARD_ROWS)
    rows = pieces.withColumn("_shard", F.pmod(F.xxhash64(*names), F.lit(shards)))
    counts = rows.groupBy("length", "_shard").count()
    # At most capacity x shards counts; a window per length.
    before = F.sum("count").over(Window.partitionBy("length").orderBy("_shard")) - F.col("count")
    counts = stored(counts.withColumn("_before", before), "lengths")
    histogram = {int(n): int(c) for n, c in counts.groupBy("length").agg(F.sum("count")).collect()}
    intervals, sequence, rank = [], 0, Counter()
    for bin_, times in best_two_fit(histogram, capacity):
        offset = 0
        for n, m in Counter(bin_).items():  # in order: equal lengths lie side by side
            intervals.append((n, rank[n], rank[n] + m * times, m, sequence, offset))
            rank[n] += m * times
            offset += n * m
        sequence += times
    plan = spark.createDataFrame(intervals, "length bigint, _from bigint, _to bigint, _times bigint, _first bigint, _offset bigint")
    order = Window.partitionBy("length", "_shard").orderBy(*names)
    ranked = rows.join(counts.drop("count"), ["length", "_shard"]).withColumn("_rank", F.col("_before") + F.row_number().over(order) - 1)
    ranked = ranked.select(*names, "_rank")
    # Bounded: a few rows per pattern and length.
    placed = ranked.join(F.broadcast(plan), "length").where("_rank >= _from and _rank < _to")
    step = F.col("_rank") - F.col("_from")
    sequence_id = F.col("_first") + F.floor(step / F.col("_times"))
    offset = F.col("_offset") + F.pmod(step, F.col("_times")) * F.col("length")
    return placed.select(*names, sequence_id.cast("bigint").alias("sequence_id"), offset.cast("bigint").alias("offset"))


def packed_documents(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece of every document, with its sequence and its place there."""
    return pack(stored(pieces_of(docs, capacity, end_id, vocabulary), "pieces"), capacity)
