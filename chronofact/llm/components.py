"""Connected components of a distributed edge list, by contraction.

Each round every node points to its smallest neighbour (or itself), pointers
are doubled until they name roots, and the edges are mapped to their ends'
roots; what is left of the edges is contracted again. Each round at least
halves the nodes that still have edges, and doubling makes a chain of n nodes
take log n joins. Every level is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch


def connected(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, root) for every node of edges (u, v); root is the smallest node of its component."""
    scratch = scratch or Scratch(edges.sparkSession, "components")
    left = scratch.cut(edges.filter(F.col("u") != F.col("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    levels: list[DataFrame] = []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        point = scratch.cut(both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("p"), F.lit(True).alias("moved")))
        while True:
            to = point.select(F.col("u").alias("p"), F.col("p").alias("q"))
            jumped = scratch.cut(point.select("u", "p").join(to, "p").select("u", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")))
            scratch.drop(point)
            point = jumped
            if point.filter("moved").isEmpty():
                break
        levels.append(point)
        a = point.select(F.col("u"), F.col("p").alias("a"))
        b = point.select(F.col("u").alias("v"), F.col("p").alias("b"))
        rest = scratch.cut(
            left.join(a, "u").join(b, "v").filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
        )
        scratch.drop(left)
        left = rest
    if not levels:
        return left.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = levels[0].select(F.col("u").alias("node"), F.col("p").alias("root"))
    for point in levels[1:]:
        step = point.select(F.col("u").alias("root"), F.col("p").alias("next"))
        out = out.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return out
