"""Exact dedup by two-pass Bloom filtering, in DataFrame functions only.

Pass 1 sends two bit positions of every text's hash to a counting filter: positions that two or more
texts share make up a Bloom filter of *repeated* hashes. Pass 2 reads the rows again against that
filter. A row with an unset bit is the only one of its text and passes straight through; only the
others are shuffled, by SHA-256, and compared exactly. A false positive costs a shuffled row, never
a wrong answer.

Positions are counted before they are shuffled, so a text that a third of all rows carry sends one
row per map task. The filter is cut into blocks of 4 KB, has 32 bits per row, and at most
``max_filter_bits``: its broadcast is bounded (128 MB by default). Beyond that the filter lets more
rows through to the exact comparison, which then does the rest.

Cases: a null text counts as empty. Of equal texts the row with the largest ``doc_id`` stays, a
null id being the smallest. Rows that repeat text and id are one document: one of them stays.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equipoise.llm.bloom import MAX_BITS, blocks_for, repeated_filter, with_membership
from equipoise.llm.common import boxed, stored, text_or_empty


def with_maybe_repeated(docs: DataFrame, text: Column, max_filter_bits: int = MAX_BITS) -> DataFrame:
    """``(row, text, maybe)``; ``maybe`` is false only if no other row has the text."""
    blocks = blocks_for(docs.count(), max_filter_bits)
    key = F.xxhash64(text)
    repeated = stored(repeated_filter(docs.select(key.alias("key")), blocks), "bloom")  # pass 1
    return with_membership(boxed(docs, text=text, key=key), repeated, blocks, "maybe")  # pass 2


def exact_groups(docs: DataFrame, max_filter_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    rows = with_maybe_repeated(docs, text_or_empty(), max_filter_bits)
    rows = rows.select(F.col("row.doc_id").alias("doc_id"), F.sha2("text", 256).alias("text_sha256"), "maybe")
    alone = rows.where(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    copies = stored(rows.where("maybe").groupBy("text_sha256", "doc_id").agg(F.count("*").alias("copies")), "copies")
    groups = stored(copies.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")), "groups")
    # Both sides are plain reads, so adaptive execution can split the partition of a hot text.
    members = copies.join(groups, "text_sha256").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return alone.unionByName(members.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256"))


def drop_exact_duplicates(docs: DataFrame, max_filter_bits: int = MAX_BITS) -> DataFrame:
    """The rows that stay, with all their columns. Rows with an equal text and id are ordered by
    their other columns, so reruns keep the same one."""
    rows = with_maybe_repeated(docs, text_or_empty(), max_filter_bits)
    names = [c for c, kind in docs.dtypes if c not in ("doc_id", "text") and "map" not in kind and "variant" not in kind]
    order = F.struct(F.col("row.doc_id"), *[F.col("row").getField(c) for c in names])
    # max_by combines in the map tasks: a hot text sends one row per task.
    best = rows.where("maybe").groupBy(F.sha2("text", 256).alias("sha")).agg(F.max_by("row", order).alias("row"))
    return rows.where(~F.col("maybe")).select("row").unionByName(best.select("row")).select("row.*")
