"""Counting exactly the first T items of a stream, then stopping.

A streaming ``limit`` would send all T items through one task. Here every micro-batch adds a
small table of aggregated updates; only the batch that crosses T is cut, and the sketches of
the parts add up to the sketch of the prefix.

A batch is read once: what it adds and how many items it held come out of one job, the number as
an observed metric. A line per batch, written behind its updates, makes them count, so updates of a
batch that turned out to cross T are replaced before anyone reads them. When T is no farther away
than the largest batch so far, the batch is kept and counted first instead.
"""

from __future__ import annotations

import threading
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from equipoise.functions.hashing import SketchParams
from equipoise.operators.frequencies import item_frequencies
from equipoise.operators.prefix import arrival_prefix, ordered_prefix
from equipoise.operators.sketches import COUNT, COUNT_MIN, EXACT, count_min_sketch, count_sketch
from equipoise.session import read_if_there

# Fixed value: the default length of a micro-batch.
DEFAULT_TRIGGER = {"processingTime": "100 milliseconds"}


def count_prefix(
    items: DataFrame,
    t: int,
    count_min: SketchParams,
    count: SketchParams,
    out: str,
    checkpoint: str,
    trigger: dict | None = None,
    order_by: str | Sequence[str] | None = None,
) -> DataFrame:
    """Process the first ``t`` items of a streaming frame and return ``(kind, d, key, counter)``.

    ``order_by`` orders the items within a micro-batch; without it they count in arrival order.
    Blocks until ``t`` items are in or a finite source ends. After a failure the same call with
    the same folders resumes where it stopped; another ``t`` needs folders of its own.
    """
    if t < 1:
        raise ValueError("the number of items must be at least 1")
    spark = items.sparkSession
    progress: dict[str, int] = {}
    reached = threading.Event()

    def cut(batch: DataFrame, left: int) -> DataFrame:
        return ordered_prefix(batch, left, order_by) if order_by else arrival_prefix(batch, left)

    def add(batch: DataFrame, batch_id: int, left: int) -> int:
        path = f"{out}/updates/batch_id={batch_id}"
        if progress["largest"] < left:
            n = _write_updates(batch, count_min, count, path)
            if n <= left:
                return n
        # The batch that crosses T, or one that may: counted and cut from one kept copy.
        batch = batch.persist()
        try:
            n = batch.count()
            if n:
                _write_updates(cut(batch, left) if n > left else batch, count_min, count, path)
            return min(n, left)
        finally:
            batch.unpersist()

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        if progress.get("next_batch") != batch_id:
            progress["done"], progress["largest"] = _processed_before(spark, out, batch_id)
        if progress["done"] < t:
            n = add(batch, batch_id, t - progress["done"])
            if n:
                line = spark.range(1, numPartitions=1).select(F.lit(n).cast("bigint").alias("n"))
                line.write.mode("overwrite").parquet(f"{out}/done/batch_id={batch_id}")
            progress["done"] += n
            progress["largest"] = max(progress["largest"], n)
        progress["next_batch"] = batch_id + 1
        if progress["done"] >= t:
            reached.set()

    query = (
        items.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(on_batch)
        .trigger(**(trigger or DEFAULT_TRIGGER))
        .start()
    )
    try:
        while not reached.is_set() and not query.awaitTermination(0.2):
            pass
    finally:
        query.stop()
    if query.exception() is not None:
        raise query.exception()
    return prefix_counters(spark, out)


def batch_updates(items: DataFrame, count_min: SketchParams, count: SketchParams) -> DataFrame:
    """``(kind, d, key, delta)`` of a batch. Sketches are built from its frequency table, whose
    shuffle the three parts share, so the items are read once."""

    def part(kind: str, table: DataFrame, d: Column | str, key: str, delta: str) -> DataFrame:
        return table.select(F.lit(kind).alias("kind"), d, F.col(key).alias("key"), F.col(delta).alias("delta"))

    freq = item_frequencies(items)
    # Counted apart: the few sketch cells stay in a small hash table beside the many items.
    return (
        part(EXACT, freq, F.lit(0).alias("d"), "item", "freq")
        .unionByName(part(COUNT_MIN, count_min_sketch(freq, count_min, weight="freq"), "d", "col", "counter"))
        .unionByName(part(COUNT, count_sketch(freq, count, weight="freq"), "d", "col", "counter"))
    )


def _write_updates(items: DataFrame, count_min: SketchParams, count: SketchParams, path: str) -> int:
    """Write the updates of a batch; the number of its items."""
    seen = Observation()
    observed = items.observe(seen, F.count(F.lit(1)).alias("n"))
    batch_updates(observed, count_min, count).write.mode("overwrite").parquet(path)
    return seen.get["n"]


def _done(spark: SparkSession, out: str) -> DataFrame | None:
    return read_if_there(spark, f"{out}/done", "n bigint, batch_id bigint")


def _processed_before(spark: SparkSession, out: str, batch_id: int) -> tuple[int, int]:
    """Items of all earlier batches, and of the largest of them."""
    done = _done(spark, out)
    if done is None:
        return 0, 0
    n = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))
    return tuple(done.where(F.col("batch_id") < batch_id).agg(*n).first())


def prefix_counters(spark: SparkSession, out: str) -> DataFrame:
    """``(kind, d, key, counter)`` of everything processed so far."""
    done = _done(spark, out)
    if done is None:
        return spark.createDataFrame([], "kind string, d int, key int, counter bigint")
    updates = spark.read.schema("kind string, d int, key int, delta bigint, batch_id bigint").parquet(f"{out}/updates")
    counted = updates.join(done.select("batch_id"), "batch_id", "left_semi")
    return counted.groupBy("kind", "d", "key").agg(F.sum("delta").alias("counter"))


def frequencies_of(counters: DataFrame) -> DataFrame:
    """The exact part of combined counters as ``(item, freq)``."""
    return counters.where(F.col("kind") == EXACT).select(
        F.col("key").alias("item"), F.col("counter").alias("freq")
    )


def count_min_of(counters: DataFrame) -> DataFrame:
    """The Count-Min part of combined counters as ``(d, col, counter)``."""
    return counters.where(F.col("kind") == COUNT_MIN).select("d", F.col("key").alias("col"), "counter")


def count_of(counters: DataFrame) -> DataFrame:
    """The Count sketch part of combined counters as ``(d, col, counter)``."""
    return counters.where(F.col("kind") == COUNT).select("d", F.col("key").alias("col"), "counter")
