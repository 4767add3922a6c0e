"""Bloom filters as tables of bit blocks, in DataFrame functions only.

A filter is ``(block, bits)`` with 4 KB of bits per row and two positions per key, both in one block,
so a lookup is one join on the block. Its size is at most ``max_bits``, whatever the table: that
bounds the broadcast. A filter that is full lets more rows through; callers compare those exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 32_768  # the width of Spark's bitmap aggregates
BITS_PER_KEY = 32
MAX_BITS = 1 << 30


def blocks_for(keys: int, max_bits: int = MAX_BITS) -> int:
    return max(1, min(keys * BITS_PER_KEY, max_bits) // BLOCK_BITS)


def _block(key: Column, blocks: int) -> Column:
    return F.shiftrightunsigned(key, 34) % F.lit(blocks)


def _positions(key: Column) -> list[Column]:
    mask = F.lit(BLOCK_BITS - 1).cast("bigint")
    return [key.bitwiseAND(mask), F.shiftrightunsigned(key, 15).bitwiseAND(mask)]


def _is_set(bits: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10)
    return F.getbit(byte.cast("bigint"), (position % 8).cast("int")) == 1


def _hits(keys: DataFrame, blocks: int) -> DataFrame:
    key = F.col("key")
    return keys.select(_block(key, blocks).alias("block"), F.explode(F.array_distinct(F.array(*_positions(key)))).alias("position"))


def member_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """Filter of all values of the bigint column ``key``."""
    return _hits(keys, blocks).groupBy("block").agg(F.bitmap_construct_agg("position").alias("bits"))


def repeated_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """Filter of the positions that at least two rows hit. Counted before the shuffle, so a value
    that a third of all rows have sends one row per map task."""
    shared = _hits(keys, blocks).groupBy("block", "position").count().where("count > 1")
    return shared.groupBy("block").agg(F.bitmap_construct_agg("position").alias("bits"))


def with_membership(rows: DataFrame, filter_: DataFrame, blocks: int, name: str) -> DataFrame:
    """Replace the column ``key`` by a flag: false only if the filter does not hold the key."""
    first, second = _positions(F.col("key"))
    # Bounded: at most MAX_BITS / 8 bytes.
    looked = rows.withColumn("block", _block(F.col("key"), blocks)).join(F.broadcast(filter_), "block", "left")
    flag = F.coalesce(_is_set(F.col("bits"), first) & _is_set(F.col("bits"), second), F.lit(False))
    return looked.withColumn(name, flag).drop("key", "block", "bits")
