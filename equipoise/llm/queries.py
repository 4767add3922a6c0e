"""The queries of this package over the test tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from equipoise.llm import filter_audit as audit_of_filters
from equipoise.llm import source_audit as audit_of_sources
from equipoise.llm.common import table
from equipoise.llm.digest import digest_documents
from equipoise.llm.exact_dedup import exact_groups
from equipoise.llm.mixing import mix_digest
from equipoise.llm.near_dedup import near_groups
from equipoise.llm.packing import packed_documents
from equipoise.llm.quality import quality_digest
from equipoise.llm.quality_rules import rules_digest
from equipoise.llm.repair import round_trip
from equipoise.llm.site_style import extract
from equipoise.llm.toxicity import toxicity_digest
from equipoise.llm.unigram import token_counts

Query = Callable[[SparkSession, str], DataFrame]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's source, its target and the words that the mix takes of it."""
    return mix_digest(spark, table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of unigram pieces of every document."""
    return token_counts(table(spark, sf_dir, "documents"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence."""
    return packed_documents(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document that stays for every document, and whether it is itself."""
    return exact_groups(table(spark, sf_dir, "documents"))


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and checksums of every document's ids, read back from the files."""
    return round_trip(table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near-duplicates of every document."""
    return near_groups(table(spark, sf_dir, "documents"))


def op6_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are."""
    return digest_documents(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document."""
    return toxicity_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and acceptance of every document."""
    return quality_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document and the verdict of the learned decision list."""
    return rules_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each step of each order of five filters removes, for every source."""
    return audit_of_filters.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of a language, and the terms each source uses most."""
    return audit_of_sources.source_audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_mixing": op1_mixing,
    "op2_token_counts": op2_token_counts,
    "op3_html": op3_html,
    "op4_packing": op4_packing,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_digest": op6_digest,
    "op7_toxicity": op7_toxicity,
    "op8_token_ids": op8_token_ids,
    "op9_quality": op9_quality,
    "op10_near_dedup": op10_near_dedup,
    "op11_quality_rules": op11_quality_rules,
    "op12_filter_audit": op12_filter_audit,
    "op13_source_audit": op13_source_audit,
}

ORACLE: dict[str, str] = {
    "op5_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op12_filter_audit": audit_of_filters.SQL,
    "op13_source_audit": audit_of_sources.SQL,
}
