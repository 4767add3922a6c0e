"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equipoise.llm.common import stored


def _star(links: DataFrame, smaller: bool) -> DataFrame:
    """Hang neighbours on the least node around: the smaller neighbours and the node itself, or the
    larger neighbours. A hub costs one joined row per neighbour; lists are never gathered."""
    if smaller:
        around = links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other"))
    else:
        around = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    least = around.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("low"))
    joined = around.join(least, "node")
    if smaller:
        hung = joined.select(F.col("other").alias("a"), F.col("low").alias("b")).unionByName(least.select(F.col("node").alias("a"), F.col("low").alias("b")))
    else:
        hung = joined.where("other > node").select(F.col("other").alias("a"), F.col("low").alias("b"))
    return hung.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` of every node with a link; the root is the least node. ``links`` is (a, b)."""
    current = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    facts = None
    while True:
        sums = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sums == facts:
            break
        facts = sums
        current = stored(_star(stored(_star(current, smaller=False), "links"), smaller=True), "links")
    roots = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
