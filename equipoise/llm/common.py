"""Small helpers that the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equipoise.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(frame: DataFrame, purpose: str) -> DataFrame:
    """Write a frame to the folder all executors share and read it back: later steps start there,
    and a lost executor costs a read instead of the whole lineage."""
    spark = frame.sparkSession
    path = shared_dir(spark, purpose)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def text_or_empty(col: str = "text") -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(col), F.lit(""))


def boxed(frame: DataFrame, **derived: Column) -> DataFrame:
    """The frame's rows as one struct ``row`` beside derived columns, so that no column of the
    input can clash with them."""
    return frame.select(F.struct(*[F.col(f"`{c}`") for c in frame.columns]).alias("row"), *[v.alias(k) for k, v in derived.items()])


def unboxed(frame: DataFrame) -> DataFrame:
    """Back to the columns that ``boxed`` put away."""
    return frame.select("row.*")
