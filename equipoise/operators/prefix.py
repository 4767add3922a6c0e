"""Exactly the first T rows, without sorting and without sending T rows through one task."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegralType, TimestampType

# Rows that a counting pass may bring to the driver.
_BUCKETS = 4096

# monotonically_increasing_id keeps the row number within a partition in its low bits.
_ROW_BITS = 33


def ordered_prefix(rows: DataFrame, t: int, order_by: str | Sequence[str]) -> DataFrame:
    """The ``t`` rows that come first by one or more columns, which must order all rows: integers,
    dates or timestamps. Other types raise ``ValueError``.

    Finds the value of the t-th row by counting ever finer ranges, at most ``_BUCKETS`` counts
    per pass, and keeps what is not beyond it: passes read the ordering columns only, and the
    result is a filter that reaches the scan. Fewer than ``t`` rows come back whole.
    """
    _check_target(t)
    columns = [order_by] if isinstance(order_by, str) else list(order_by)
    keep, tied, left = F.lit(False), F.lit(True), t
    for name in columns:
        value = _integer_key(rows, name)
        found = _range_of_row(rows.where(tied).select(value.cast("bigint").alias(name)), left)
        if found is None:
            return rows
        cut, before, held = found
        if before + held == left:
            return rows.where(keep | (tied & (value <= cut)))
        keep = keep | (tied & (value < cut))
        tied = tied & (value == cut)
        left -= before
    raise ValueError(f"{columns} leave {held} rows tied at row {t}; add a column that tells them apart")


def _integer_key(rows: DataFrame, name: str) -> Column:
    """The column as whole numbers in the same order; search and filter use this one key."""
    kind = rows.schema[name].dataType
    if isinstance(kind, IntegralType):
        return F.col(name)
    if isinstance(kind, DateType):
        return F.unix_date(name)
    if isinstance(kind, TimestampType):
        return F.unix_micros(name)
    raise ValueError(f"{name} is {kind.simpleString()}; order by integers, dates or timestamps")


def _range_of_row(column: DataFrame, t: int) -> tuple[int, int, int] | None:
    """Upper end of a value range that holds row ``t``, the rows below it and the rows in it.

    The range ends exactly at row ``t`` or is down to a single value. None if no more than ``t``
    rows exist, which only the first ordering column can find: others look at too many ties.
    """
    name = column.columns[0]
    value = F.col(name)
    low, high, filled, total = column.agg(F.min(value), F.max(value), F.count(value), F.count("*")).first()
    if filled < total:
        raise ValueError(f"{name} must not be null")
    if total <= t:
        return None
    before = 0
    while True:
        width = -(-(high - low + 1) // _BUCKETS)
        gaps = column.where(value.between(low, high)).select((value - F.lit(low)).alias("gap"))
        slots = gaps.groupBy(F.expr(f"gap div {width}L").alias("slot")).agg(F.count("*").alias("n"))
        for slot, n in sorted(map(tuple, slots.collect())):
            if before + n >= t:
                break
            before += n
        low, high = low + slot * width, min(high, low + (slot + 1) * width - 1)
        if low == high or before + n == t:
            return high, before, n


def arrival_prefix(rows: DataFrame, t: int) -> DataFrame:
    """``t`` rows in partition order, for a source whose arrival order is the only order there is.

    Rows are numbered within their partitions and only the counts reach the driver, so unlike
    ``limit`` nothing is moved. The input must replay the same partitions when it is recomputed.
    """
    _check_target(t)
    numbered = rows.withColumn("_arrival", F.monotonically_increasing_id())
    part = F.shiftright("_arrival", _ROW_BITS)
    counts = sorted(map(tuple, numbered.groupBy(part.alias("part")).agg(F.count("*")).collect()))
    for (part_no, n), seen in zip(counts, accumulate(n for _, n in counts)):
        if seen >= t:
            cut = (part_no << _ROW_BITS) + (t - (seen - n))
            return numbered.where(F.col("_arrival") < cut).drop("_arrival")
    return rows


def _check_target(t: int) -> None:
    if t < 1:
        raise ValueError("the number of rows must be at least 1")
