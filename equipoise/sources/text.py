"""Text scans and the parsers of labelled points and items.

Parsers take a frame with a text column, replace it by the parsed columns and keep the rest.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the form of an integer token.
_INTEGER = r"^[+-]?\d+$"

CLUSTER_ID_RULES = ("auto", "yes", "no")


def read_lines(spark: SparkSession, path: str, num_partitions: int | None = None) -> DataFrame:
    """One row per line in column ``value``, in at least ``num_partitions`` splits of the scan.

    The splits are planned by settings of this one read, in a session of its own, so nothing is
    shuffled and other reads are planned as before. Compressed files cannot be split.
    """
    if num_partitions is None:
        return spark.read.text(path)
    if num_partitions < 1:
        raise ValueError("num_partitions must be at least 1")
    planner = spark.newSession()
    splits = max(num_partitions + 2, spark.sparkContext.defaultParallelism)  # it is rounded down
    planner.conf.set("spark.sql.files.minPartitionNum", splits)
    planner.conf.set("spark.sql.files.openCostInBytes", 1)
    planner.conf.set("spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes"))
    name = f"lines_{uuid.uuid4().hex}"
    planner.read.text(path).createGlobalTempView(name)  # what both sessions can see
    try:
        return spark.table(f"global_temp.{name}")
    finally:
        spark.catalog.dropGlobalTempView(name)


def read_documents(spark: SparkSession, path: str, num_partitions: int | None = None) -> DataFrame:
    """One document per line in column ``text``."""
    return read_lines(spark, path, num_partitions).withColumnRenamed("value", "text")


def comma_tokens(line: Column) -> Column:
    """Comma-separated tokens without the empty ones at the end."""
    return F.split(F.rtrim(line, F.lit(",")), ",")


def integer_or_null(token: Column) -> Column:
    """A 32-bit integer written with an optional sign and digits only, else null."""
    return F.when(token.rlike(_INTEGER), token.try_cast("int"))


def _is_finite(value: Column) -> Column:
    # NaN compares above every number.
    return F.coalesce(F.abs(value) < float("inf"), F.lit(False))


def parse_points(lines: DataFrame, line_col: str = "value", has_cluster_id: str = "no") -> DataFrame:
    """``coords array<double>, grp`` from ``x1,...,xd,group[,cluster]``.

    Lines with fewer than two tokens are skipped, a bad number fails the job. A trailing cluster
    id is ignored: ``yes`` expects one, ``auto`` takes any trailing integer for one.
    """
    if has_cluster_id not in CLUSTER_ID_RULES:
        raise ValueError(f"has_cluster_id must be one of {CLUSTER_ID_RULES}: {has_cluster_id!r}")
    rest = [c for c in lines.columns if c != line_col]
    tokens = F.col("_tokens")
    size = F.size(tokens)
    if has_cluster_id == "no":
        group_at = size
    elif has_cluster_id == "yes":
        group_at = size - 1
    else:
        last_is_id = integer_or_null(F.element_at(tokens, -1)).isNotNull()
        group_at = F.when(last_is_id, size - 1).otherwise(size)
    # Two tokens take a comma that is not at the end; asking for that spares the filter a split.
    two_tokens = F.contains(F.rtrim(F.col(line_col).cast("string"), F.lit(",")), F.lit(","))
    split = lines.where(two_tokens).select(*rest, comma_tokens(F.col(line_col).cast("string")).alias("_tokens"))
    located = split.withColumn("_at", group_at)
    numbers = F.transform(F.slice(tokens, F.lit(1), F.col("_at") - 1), lambda t: t.try_cast("double"))
    message = F.concat(F.lit("not a finite coordinate in: "), F.concat_ws(",", tokens))
    checked = F.when(F.forall("_numbers", _is_finite), F.col("_numbers")).otherwise(
        F.raise_error(message).cast("array<double>")
    )
    return located.withColumn("_numbers", numbers).select(
        *rest, checked.alias("coords"), F.element_at(tokens, F.col("_at")).alias("grp")
    )


def parse_clustered_points(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """``x, y, grp, cluster, reason`` from ``x,y,group,cluster`` lines, bad lines included.

    ``reason`` says why a line is bad and is null on good ones. The group is the first character
    of the next-to-last token; the line column stays, so that rejects can be reported.
    """
    tokens = F.col("_tokens")
    size = F.size(tokens)
    parsed = lines.withColumn("_tokens", comma_tokens(F.col(line_col).cast("string"))).select(
        *lines.columns,
        F.get(tokens, F.lit(0)).try_cast("double").alias("x"),
        F.get(tokens, F.lit(1)).try_cast("double").alias("y"),
        F.substring(F.get(tokens, size - 2), 1, 1).alias("grp"),
        integer_or_null(F.get(tokens, size - 1)).alias("cluster"),
        size.alias("_size"),
    )
    reason = (
        F.when(F.col("_size") < 2, "too few values")
        .when(~_is_finite(F.col("x")), "x is not a finite number")
        .when(~_is_finite(F.col("y")), "y is not a finite number")
        .when(F.col("grp") == "", "group is empty")
        .when(F.col("cluster").isNull(), "cluster is not an integer")
    )
    return parsed.withColumn("reason", reason).drop("_size")


def good_points(parsed: DataFrame) -> DataFrame:
    """The points of ``parse_clustered_points``."""
    return parsed.where(F.col("reason").isNull()).select("x", "y", "grp", "cluster")


def rejected_lines(parsed: DataFrame, line_col: str = "value") -> DataFrame:
    """The lines ``parse_clustered_points`` could not read, and why."""
    return parsed.where(F.col("reason").isNotNull()).select(F.col(line_col).alias("line"), "reason")


def parse_items(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """``item int`` from one decimal integer per line; anything else fails the job."""
    rest = [c for c in lines.columns if c != line_col]
    token = F.col(line_col).cast("string")  # message queues deliver bytes
    message = F.concat(F.lit("not a 32-bit integer: "), token)
    item = integer_or_null(token)
    return lines.select(
        *rest, F.when(item.isNotNull(), item).otherwise(F.raise_error(message).cast("int")).alias("item")
    )


def stream_lines(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Lines of text files as they appear in a folder, in column ``value``.

    Any other streaming frame with a ``value`` column, such as a socket or a message queue,
    works with the parsers as well.
    """
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)
