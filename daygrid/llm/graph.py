"""Connected components by alternating large and small stars, in plain joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygrid.session import stable


def _stars(edges: DataFrame) -> bool:
    """Whether no node of the distinct edges (u, v), u > v, has two smaller nodes or both a smaller and a larger one."""
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("low"), F.col("v").alias("high"), F.lit(False).alias("root")).union(
        edges.select(F.col("v").alias("node"), F.lit(None), F.lit(None), F.lit(True))
    )
    nodes = ends.groupBy("node").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("root").alias("root"))
    return nodes.filter("low < high OR (root AND low IS NOT NULL)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); the root is the component's smallest node.

    Each round is a grouping by node with map-side minima and a join that can be
    split where a node is hot. The rounds grow with the logarithm of the nodes and
    end when every node hangs on one root, which is itself on none.
    """
    edges = stable(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges"
    )
    while not _stars(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = stable(large, "large_star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(least, "u")
        small = (
            down.filter("v <> m")
            .select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        edges = stable(small, "small_star")
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return stable(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots), "components")
