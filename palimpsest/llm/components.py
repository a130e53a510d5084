"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import written


def _settled(links: DataFrame) -> bool:
    """Whether all links are stars: each node has one link down at most, and leads nowhere if links lead to it."""
    ends = links.select("a", F.lit(1).alias("down"), F.lit(0).alias("root")).unionByName(links.select(F.col("b").alias("a"), F.lit(0).alias("down"), F.lit(1).alias("root")))
    return ends.groupBy("a").agg(F.sum("down").alias("down"), F.max("root").alias("root")).filter("down > 1 or (down > 0 and root > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); a component is named by its least node.

    Alternates two steps until all links are stars: every node links its larger neighbours to
    its least one (large star), then its smaller neighbours and itself to the least of
    these (small star). Each is a grouped minimum and a join, so a node with very many
    neighbours is split like any skewed key. Self-links and repeated links do no harm;
    nodes in no link but to themselves are left out. The number of rounds grows with the
    logarithm of the longest chain.
    """
    links = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    size = links.count()
    current = written(links.distinct(), "edges", size)
    while not _settled(current):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b"))).filter("a <> b").distinct()
        current = written(small, "edges", 2 * size)  # no step makes more links than it is given, and one for each node
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
