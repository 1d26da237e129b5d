"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import shared, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    Each step hangs the neighbours of a node on the smallest of them, so the edges never outnumber the first ones
    and the number of steps grows with the logarithm of the largest component. Self links and repeated edges do no
    harm; rows with a null end are left out; an empty table gives an empty one.
    """
    pairs = edges.where(F.col("a") != F.col("b"))
    now = written(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        now = _hung(both, F.col("b") > F.col("a"), keep_self=False)
        now = written(_hung(now, F.lit(True), keep_self=True), "edges")
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if sign == before:
            break
        before = sign
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots).distinct()


def _hung(edges: DataFrame, of, keep_self: bool) -> DataFrame:
    """Every neighbour b of a (for which ``of`` holds), and a itself if ``keep_self``, hung on a's smallest neighbour."""
    least = edges.groupBy("a", shared(F.col("a")).alias("__s")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
    hung = edges.where(of).join(least.select("a", "m"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if keep_self:
        hung = hung.unionByName(least.select("a", F.col("m").alias("b")))
    return hung.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
