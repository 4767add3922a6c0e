"""A keyed table of counters that micro-batches change: deltas, snapshots and a manifest.

Every batch writes the counters it changed into a delta folder of its own, so a replayed batch
overwrites itself. Every ``snapshot_every`` batches the last snapshot and the deltas since then are
merged into the next snapshot. A line in the manifest, written last, makes it count. What a reader of
the snapshot before could still need is kept until the one after it, and dropped then. So reading
back costs one snapshot and at most ``2 * snapshot_every`` deltas, however many batches there were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equipoise.session import drop_folder, read_if_there

SNAPSHOT_EVERY = 16

_KEY = ["kind", "d", "key"]
_COUNTERS = "kind string, d int, key int, counter bigint"


class CounterVersions:
    """Counters below a folder ``out``; one writer, any number of readers."""

    def __init__(self, out: str, snapshot_every: int = SNAPSHOT_EVERY) -> None:
        if snapshot_every < 1:
            raise ValueError("a snapshot needs at least one batch")
        self.out = out
        self.snapshot_every = snapshot_every
        self._snapshots: list[int] | None = None

    def snapshots(self, spark: SparkSession) -> list[int]:
        """Last batches of the snapshots that count, oldest first; at most two are kept."""
        lines = read_if_there(spark, f"{self.out}/manifest", "written bigint, upto bigint")
        return sorted(row.upto for row in lines.select("upto").collect()) if lines is not None else []

    def write(self, changed: DataFrame, batch_id: int) -> None:
        """Add the ``(kind, d, key, counter)`` that a batch changed."""
        spark = changed.sparkSession
        if self._snapshots is None:
            self._snapshots = self.snapshots(spark)
        if self._snapshots and batch_id <= self._snapshots[-1]:
            return  # replayed after its snapshot was taken
        changed.select(*_KEY, "counter").write.mode("overwrite").parquet(f"{self.out}/delta/batch_id={batch_id}")
        last = self._snapshots[-1] if self._snapshots else -1
        if batch_id - last >= self.snapshot_every:
            self._take_snapshot(spark, batch_id)

    def _take_snapshot(self, spark: SparkSession, upto: int) -> None:
        self._merged(spark, self._snapshots, upto).write.mode("overwrite").parquet(f"{self.out}/snapshot-{upto}")
        line = spark.range(1, numPartitions=1).select(F.lit(upto).cast("bigint").alias("written"))
        line.write.mode("overwrite").parquet(f"{self.out}/manifest/upto={upto}")
        self._snapshots.append(upto)
        while len(self._snapshots) > 2:
            self._drop(spark, self._snapshots.pop(0), self._snapshots[0])

    def _drop(self, spark: SparkSession, old: int, oldest_kept: int) -> None:
        """Drop a snapshot and the deltas that the next one holds."""
        drop_folder(spark, f"{self.out}/manifest/upto={old}")
        drop_folder(spark, f"{self.out}/snapshot-{old}")
        deltas = read_if_there(spark, f"{self.out}/delta", f"{_COUNTERS}, batch_id bigint")
        held = deltas.where(F.col("batch_id") <= oldest_kept).select("batch_id").distinct().collect()
        for row in held:  # some snapshot_every folders
            drop_folder(spark, f"{self.out}/delta/batch_id={row.batch_id}")

    def _merged(self, spark: SparkSession, snapshots: list[int], upto: int | None = None) -> DataFrame:
        last = snapshots[-1] if snapshots else -1
        parts = []
        if snapshots:
            parts.append(spark.read.schema(_COUNTERS).parquet(f"{self.out}/snapshot-{last}").withColumn("batch_id", F.lit(last).cast("bigint")))
        deltas = read_if_there(spark, f"{self.out}/delta", f"{_COUNTERS}, batch_id bigint")
        if deltas is not None:
            newer = deltas.where(F.col("batch_id") > last)
            parts.append(newer if upto is None else newer.where(F.col("batch_id") <= upto))
        if not parts:
            return spark.createDataFrame([], _COUNTERS)
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return rows.groupBy(*_KEY).agg(F.max_by("counter", "batch_id").alias("counter"))

    def latest(self, spark: SparkSession) -> DataFrame:
        """``(kind, d, key, counter)`` as of the last batch written."""
        return self._merged(spark, self.snapshots(spark))
