"""Connected components of a link table, without collecting links or nodes.

Alternating large-star and small-star steps: every step is an aggregation
(partial before the shuffle) and an equi-join, and each round is written to the
shared folder, so neither lineage nor a lost executor matters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.storage import materialize, release


def _digest(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(20,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node in ``links(a, b)`` other than roots; root is the smallest node.

    ``links`` may hold repeats, both directions or self-links; null ends are ignored.
    """
    spark = links.sparkSession
    canonical = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges, at = materialize(canonical.distinct(), "links")
    before = _digest(edges)
    while before[0]:
        # Large star: every larger neighbour of a node is linked to the node's smallest neighbour.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).select(F.col("a").alias("u"), "m")
        # Written: with a plain scan under each exchange a hot node's rows can be split.
        least, least_at = materialize(least, "least")
        large = (
            edges.join(least, edges.b == least.u)
            .select(F.col("a"), F.col("m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        large, large_at = materialize(large, "large")
        # Small star: a node and its smaller neighbours are linked to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        low, low_at = materialize(low, "low")
        small = (
            large.join(low, large.a == low.u)
            .select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        small, small_at = materialize(small, "small")
        release(spark, at, large_at, least_at, low_at)
        edges, at = small, small_at
        now = _digest(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
