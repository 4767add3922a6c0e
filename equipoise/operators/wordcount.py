"""Word frequencies of a document set, with three plans that give the same answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equipoise.functions.tokens import space_tokens, text_lines

STRATEGIES = ("direct", "salted", "partition")


def documents_by_line(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """Every line of every text as a document of its own; other columns are kept."""
    rest = [c for c in documents.columns if c != text_col]
    return documents.select(*rest, F.explode(text_lines(F.col(text_col))).alias(text_col))


def num_documents(documents: DataFrame) -> DataFrame:
    return documents.agg(F.count("*").alias("num_docs"))


def word_count(
    documents: DataFrame,
    strategy: str = "direct",
    text_col: str = "text",
    num_salts: int = 16,
) -> DataFrame:
    """``(word, n)`` over all documents.

    ``direct`` is one shuffle of pre-aggregated counts, in which a frequent word costs one row
    per map task; it is the plan to use. ``partition`` counts within each input partition first,
    which is what the aggregate does before its shuffle, so its plan is the same. ``salted``
    counts in two shuffled rounds, the first keyed by a salt, and exists to compare the plans.
    """
    text = F.col(text_col)
    if strategy in ("direct", "partition"):
        words = documents.select(F.explode(space_tokens(text)).alias("word"))
        return words.groupBy("word").agg(F.count("*").alias("n"))
    if strategy == "salted":
        if num_salts < 1:
            raise ValueError("num_salts must be at least 1")
        # A hash of the content, unlike a random number, salts a retried task the same way. It is
        # taken before the words part, or every word would hash its whole text.
        hashed = documents.select(F.xxhash64(text).alias("doc_hash"), text.alias("text"))
        words = hashed.select("doc_hash", F.explode(space_tokens(F.col("text"))).alias("word"))
        key = F.pmod(F.xxhash64("doc_hash", "word"), F.lit(num_salts))
    else:
        raise ValueError(f"strategy must be one of {STRATEGIES}: {strategy!r}")
    first = words.withColumn("round_key", key).groupBy("round_key", "word").agg(F.count("*").alias("n"))
    return first.groupBy("word").agg(F.sum("n").alias("n"))


def distinct_words(counts: DataFrame) -> DataFrame:
    """Number of distinct words of a ``word_count`` result."""
    return counts.agg(F.count("*").alias("num_words"))


def mean_word_length(counts: DataFrame) -> DataFrame:
    """Mean length, in characters, of the distinct words of a ``word_count`` result."""
    return counts.agg(F.avg(F.length("word")).alias("avg_len"))


def word_statistics(counts: DataFrame) -> DataFrame:
    """Distinct words and their mean length in one pass."""
    return counts.agg(F.count("*").alias("num_words"), F.avg(F.length("word")).alias("avg_len"))
