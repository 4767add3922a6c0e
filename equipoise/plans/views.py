"""Views over the test tables and the fixed parameters that the query catalogue uses."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equipoise.functions.hashing import HashRow, SketchParams, wrapped_int
from equipoise.sources.replay import replay, stage_in_order

# Fixed values of the catalogue: centres, a second set to compare with, hash parameters.
CENTERS = ((10.0, 5.0), (25.0, 20.0), (40.0, 40.0), (55.0, 10.0))
OTHER_CENTERS = ((12.0, 30.0), (30.0, 10.0), (45.0, 25.0))
# Only points of A are near the first, only points of B near the third, and none near the last.
LONE_CENTERS = ((0.0, 25.0), (30.0, 25.0), (90.0, 25.0), (-500.0, -500.0))
SHIFT = 100_000.0
START_SEED = 123
COUNT_MIN_ROWS = (
    (1931, 4027), (7873, 12), (402, 8190), (5519, 3301), (8190, 777), (64, 5108), (3067, 0),
)
COUNT_ROWS = (
    (2749, 611, 5003, 1290), (6133, 7042, 911, 3), (88, 2500, 7717, 6001), (7129, 1, 2063, 4444),
    (5, 8001, 6857, 59), (3571, 3571, 14, 8190), (8089, 905, 4111, 2222),
)
SKETCH_WIDTH = 97
EVEN_SKETCH_WIDTH = 100
EVEN_SKETCH_DEPTH = 4
LARGE_SKETCH_WIDTH = 1_000_003
TOP_K = 10
SAMPLE_ROWS = 25
REPLAY_FILES = 6

COUNT_MIN_PARAMS = SketchParams(tuple(HashRow(*r) for r in COUNT_MIN_ROWS), SKETCH_WIDTH)
COUNT_PARAMS = SketchParams(tuple(HashRow(*r) for r in COUNT_ROWS), SKETCH_WIDTH)
LARGE_COUNT_MIN_PARAMS = COUNT_MIN_PARAMS._replace(width=LARGE_SKETCH_WIDTH)
LARGE_COUNT_PARAMS = COUNT_PARAMS._replace(width=LARGE_SKETCH_WIDTH)
EVEN_COUNT_PARAMS = SketchParams(
    tuple(HashRow(*r) for r in COUNT_ROWS[:EVEN_SKETCH_DEPTH]), EVEN_SKETCH_WIDTH
)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet")).select(*columns)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text")


def points_xy(spark: SparkSession, sf_dir: str, keep_foreign: bool = False) -> DataFrame:
    """``(point_id, x, y, grp)`` over orders: finished orders are group A, the rest B and shifted.

    ``keep_foreign`` labels pending orders C, a group of neither kind.
    """
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", "o_orderstatus", "o_custkey")
    finished = F.col("o_orderstatus") == "F"
    grp = F.when(finished, "A")
    if keep_foreign:
        grp = grp.when(F.col("o_orderstatus") == "P", "C")
    return orders.select(
        F.col("o_orderkey").alias("point_id"),
        (F.col("o_totalprice") / 10000.0 + F.when(finished, 0.0).otherwise(20.0)).alias("x"),
        (F.col("o_custkey") % 50).cast("double").alias("y"),
        grp.otherwise("B").alias("grp"),
    )


def points(spark: SparkSession, sf_dir: str, keep_foreign: bool = False) -> DataFrame:
    """``points_xy`` with the coordinates as an array, the form all operators take."""
    xy = points_xy(spark, sf_dir, keep_foreign)
    return xy.select("point_id", F.array("x", "y").alias("coords"), "grp")


def shifted_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``points`` far away from the catalogue's centres."""
    far = F.transform("coords", lambda v: v + SHIFT)
    return points(spark, sf_dir).select("point_id", far.alias("coords"), "grp")


def start_key() -> Column:
    """A hash of the row's identifier that SQL can compute as well."""
    digest = F.md5(F.concat(F.lit(f"{START_SEED}:"), F.col("point_id").cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(point_id, coords, grp, label)`` over embeddings: 64 dimensions, labels below 3 are group A."""
    return table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label").select(
        F.col("vec_id").alias("point_id"),
        F.col("embedding").cast("array<double>").alias("coords"),
        F.when(F.col("label") < 3, "A").otherwise("B").alias("grp"),
        "label",
    )


def label_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(center_id, coords)``: the mean embedding of every label."""
    vectors = embedding_points(spark, sf_dir)
    means = F.array(*[F.avg(F.col("coords")[j]) for j in range(EMBEDDING_DIM)])
    return vectors.groupBy(F.col("label").alias("center_id")).agg(means.alias("coords"))


EMBEDDING_DIM = 64


def item_of(user_id: Column) -> Column:
    """Wide 32-bit ids, so that hashing wraps around.

    The ids wrap as well: the factor is odd, so users share an item only if their ids are equal
    modulo 2^32.
    """
    return wrapped_int(wrapped_int(user_id).cast("bigint") * 104729 + 1500000000)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(seq, item)`` over events."""
    events = table(spark, sf_dir, "events", "event_id", "user_id")
    return events.select(F.col("event_id").alias("seq"), item_of(F.col("user_id")).alias("item"))


def item_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``items`` as a stream over the same files."""
    path = os.path.join(sf_dir, "events.parquet")
    reader = spark.readStream.schema("event_id bigint, user_id bigint")
    # A table that is one file is streamed as the only match in its folder.
    events = (
        reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
        if os.path.isfile(path)
        else reader.parquet(path)
    )
    return events.select(F.col("event_id").alias("seq"), item_of(F.col("user_id")).alias("item"))


def item_replay(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """``items`` as a stream of ``REPLAY_FILES`` micro-batches, each a stretch of the sequence."""
    stage_in_order(items(spark, sf_dir), "seq", REPLAY_FILES, folder)
    return replay(spark, folder, "seq bigint, item int")
