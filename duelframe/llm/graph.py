"""Connected components of a table of links, by contraction of forests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.llm.common import saved


def _roots(parent: DataFrame) -> DataFrame:
    """(node, root) of a forest given as (node, root) with smaller parents, by pointer jumping: depths halve each round."""
    while True:
        above = parent.select(F.col("node").alias("root"), F.col("root").alias("beyond"))
        moved = saved(parent.join(above, "root", "left").select("node", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        parent = moved.select("node", "root")
        if not moved.where("moved").limit(1).count():
            return parent


def components(links: DataFrame, *, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of a link; a component is named by its smallest node.

    Every node keeps one link at first, that to its smallest neighbour below it. These form a forest, whose roots
    are found by pointer jumping. All links are then looked at once, between roots, and only those that still join different
    roots go on, usually very few; so copies that are linked many times over cost one pass and not one a round.
    A hub with very many links is met by partial minima before the shuffle, and AQE splits its joins.
    """
    left = saved(links.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo <> hi").distinct(), "links")
    labels = None
    while True:
        roots = _roots(saved(left.groupBy("hi").agg(F.min("lo").alias("root")).withColumnRenamed("hi", "node"), "forest"))
        if labels is None:
            labels = roots
        else:
            next_root = roots.select(F.col("node").alias("root"), F.col("root").alias("beyond"))
            labels = saved(labels.join(next_root, "root", "left").select("node", F.coalesce("beyond", "root").alias("root")).union(roots), "labels")
        of_lo, of_hi = (roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in ("lo", "hi"))
        ends = left.join(of_lo, "lo", "left").join(of_hi, "hi").select(F.coalesce("lo_root", "lo").alias("x"), F.col("hi_root").alias("y"))
        left = saved(ends.where("x <> y").select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).distinct(), "links")
        if not left.limit(1).count():
            break
    tops = labels.select(F.col("root").alias("node"), "root").distinct()
    return labels.union(tops).select("node", F.col("root").alias("component"))
