"""Running exact counts and sketches of a whole stream, kept by the streaming state store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from equipoise.functions.hashing import SketchParams
from equipoise.operators.sketches import kind_name, sketch_updates
from equipoise.streaming.versions import SNAPSHOT_EVERY, CounterVersions


def running_counters(items: DataFrame, count_min: SketchParams, count: SketchParams) -> DataFrame:
    """Streaming ``(kind, d, key, counter)``.

    Exact counts and both sketches share one aggregation, so that they always describe the same
    items.
    """
    updates = sketch_updates(items, count_min, count)
    counters = updates.groupBy("kind", "d", "key").agg(F.sum("delta").alias("counter"))
    return counters.select(kind_name().alias("kind"), "d", "key", "counter")


def start_counters(
    counters: DataFrame,
    out: str,
    checkpoint: str,
    trigger: dict | None = None,
    snapshot_every: int = SNAPSHOT_EVERY,
) -> StreamingQuery:
    """Keep the counters that micro-batches change below ``out``, as ``CounterVersions``."""
    versions = CounterVersions(out, snapshot_every)
    writer = counters.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(versions.write).trigger(**(trigger or {"availableNow": True})).start()


def latest_counters(spark: SparkSession, out: str) -> DataFrame:
    """``(kind, d, key, counter)`` as of the last batch written: the last snapshot and what came
    after it."""
    return CounterVersions(out).latest(spark)
