"""Connected components of a table of links, by rounds of joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _nearest(both: DataFrame) -> DataFrame:
    """For each node the least of its neighbours and itself."""
    return both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of links (a, b); root is the least node reachable.

    Alternating large and small stars: each round hooks neighbours to the least
    node seen, with minima that are combined before the shuffle, so a node with
    very many links stays one row a task.  Lineage is cut each round.  An empty
    table gives no rows; self-links give a component of one.
    """
    links = cut(links)
    own = links.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("root"))
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_nearest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = _nearest(large)
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = cut(small.where("u <> v").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == last:
            break
        last = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root"))
    return found.unionByName(roots).unionByName(own).groupBy("node").agg(F.min("root").alias("root"))
