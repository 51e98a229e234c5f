"""Connected components of a graph given as an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import stored


def _to_least(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. Each node's least neighbour (itself included) takes over its larger (large star) or its smaller
    neighbours and the node itself (small star). The minimum is a partial aggregate, so a hub is no single task's load."""
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    both = both.distinct()
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    linked = both.join(least, "a")
    if large:
        out = linked.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node that can be reached.

    Large and small stars alternate until nothing changes, about log(number of nodes) rounds; each round ends in a
    stored table, so a lost executor costs one round. No edges give no rows.
    """

    def state(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = stored(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    before = None
    while (seen := state(now)) != before:
        before = seen
        now = stored(_to_least(_to_least(now, large=True), large=False), "stars")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root"))
    ).distinct()
