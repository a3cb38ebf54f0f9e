"""Connected components over an edge table, by alternating large-star and small-star rounds.

Hot nodes: links meet their node's least neighbour in join_hot, where the nodes with very many
links are broadcast and only the links of all others are shuffled.

Defined results: an empty edge table gives no rows; repeated edges count once; edges whose
ends are null do not occur (callers key nodes by values that are never null).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import forget, join_hot, store


def _with_least(links: DataFrame, pairs: DataFrame, ends: int) -> DataFrame:
    """links (u, v) with m, the least v that u has in pairs (u, v), of which there are ``ends`` at most."""
    return join_hot(links, pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "u", ends)


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour (or itself): a link for each edge."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return _with_least(both.filter("v > u"), both, 2 * n).select(F.col("v").alias("a"), F.least("u", "m").alias("b"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, is linked to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    own = down.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("a"), F.col("m").alias("b"))
    return _with_least(down, down, n).filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(own)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; component is its least reachable node.

    edges: (a, b) of one orderable type, a != b, repeats allowed. Each round is written
    to the shared folder and read back, so lost executors cost one round at most.
    """
    spark = edges.sparkSession
    current, path = store(edges.select("a", "b").distinct(), "edges")
    before, n = None, current.count()
    while True:
        after, after_path = store(_small_star(_large_star(current, n), n).distinct(), "edges")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        forget(spark, path)
        current, path = after, after_path
        if state == before or not state[0]:
            break
        before, n = state, state[0]
    found = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.union(found.select(F.col("component").alias("node"), "component").distinct())
