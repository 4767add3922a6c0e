"""A table as a stream of many micro-batches in a known order."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Files of a stream are taken by modification time; the times of a replay are this far apart.
_STEP_MS = 1_000


def stage_in_order(rows: DataFrame, order_by: str, files: int, folder: str) -> None:
    """Write the rows below ``folder`` as at most ``files`` numbered files: a file holds a range of
    ``order_by``, sorted, and files follow each other in that order.

    One range shuffle and no task with more than its range; the driver touches file names only.
    Rows of equal ``order_by`` share a file.
    """
    if files < 1:
        raise ValueError("the number of files must be at least 1")
    rows.repartitionByRange(files, order_by).sortWithinPartitions(order_by).write.option("maxRecordsPerFile", 0).parquet(folder)
    _date_in_order(rows.sparkSession, folder)


def _date_in_order(spark: SparkSession, folder: str) -> None:
    """Give the files modification times in the order of their numbers."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((f for f in system.listStatus(path) if re.match(r"part-\d+", f.getPath().getName())), key=lambda f: f.getPath().getName())
    newest = max((f.getModificationTime() for f in files), default=0)
    for age, file in enumerate(reversed(files)):
        system.setTimes(file.getPath(), newest - age * _STEP_MS, -1)
    times = [system.getFileStatus(f.getPath()).getModificationTime() for f in files]
    if any(a >= b for a, b in zip(times, times[1:])):
        raise ValueError(f"the file system of {folder} does not keep modification times")


def replay(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """The staged rows as a stream, ``files_per_batch`` files a micro-batch, in their order."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def staged_files(spark: SparkSession, folder: str, order_by: str) -> DataFrame:
    """``(file, n, first, last)`` of every staged file: where each micro-batch begins and ends."""
    rows = spark.read.parquet(folder).select(F.col("_metadata.file_name").alias("file"), order_by)
    return rows.groupBy("file").agg(F.count("*").alias("n"), F.min(order_by).alias("first"), F.max(order_by).alias("last"))
