"""Connected components by rounds of large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmatch.session import cut_lineage


def _star(pairs: DataFrame) -> DataFrame:
    """Each (node, other) with the smallest of the node and all its others."""
    least = pairs.groupBy("node").agg(F.min("other").alias("__least"))
    return pairs.join(least, "node").withColumn("__least", F.least("node", "__least"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("other", "node"))
    stars = _star(both).where(F.col("other") > F.col("node"))
    return stars.select(F.col("other").alias("node"), F.col("__least").alias("other")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    stars = _star(edges.where(F.col("other") < F.col("node")))
    turned = F.array(F.col("node"), F.col("other"))
    return (
        stars.select(F.explode(turned).alias("node"), F.col("__least").alias("other"))
        .where("node <> other").distinct()
    )


def connected(edges: DataFrame) -> DataFrame:
    """Root (smallest node reachable) of every node of ``edges`` (two columns of long).

    Works on minima and joins: no group is gathered in one task and no link reaches the driver,
    which reads two numbers a round to see that nothing moves any more. Each round cuts the
    lineage in the shared checkpoint folder. Loops and repeated edges are ignored.
    Returns ``node, root``, roots included; nodes without an edge to another are absent.
    """
    first, second = edges.columns
    edges = edges.where(F.col(first) != F.col(second)).select(
        F.greatest(first, second).alias("node"), F.least(first, second).alias("other")
    )
    edges = cut_lineage(edges.distinct())
    mark = None
    while True:
        edges = cut_lineage(_small_star(_large_star(edges)))
        now = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("node", "other").cast("decimal(38,0)"))
        ).first()
        if now == mark:
            roots = edges.select(F.col("other").alias("root"))
            return edges.select("node", F.col("other").alias("root")).union(roots.select(F.col("root").alias("node"), "root").distinct())
        mark = now
