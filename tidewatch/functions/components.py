"""Connected components of an edge table by hooking and contraction.

Each round every node with a smaller neighbour hooks to the smallest one,
hooks are followed a few steps, and the edges are rewritten between the nodes
reached; edges inside a component disappear.  The loop ends when no edge is
left, so the result is always complete.  Each round is written to the shared
scratch folder, which cuts lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import materialize

JUMPS = 3


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b): comp is the smallest
    node of its component.  Nulls are no nodes; nodes without edges are not listed."""
    def between(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    left = materialize(between(edges.select("a", "b")), "edges")
    nodes = left.select(F.col("a").alias("node")).union(left.select("b")).distinct().withColumn("comp", F.col("node"))
    nodes = materialize(nodes, "components")
    while not left.isEmpty():
        up = materialize(left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")), "hooks")
        for _ in range(JUMPS):
            nxt = up.select(F.col("node").alias("up"), F.col("up").alias("_over"))
            up = up.join(nxt, "up", "left").select("node", F.coalesce("_over", "up").alias("up"))
        up = materialize(up, "hooks")

        def moved(df: DataFrame, c: str) -> DataFrame:
            to = up.select(F.col("node").alias(c), F.col("up").alias("_to"))
            return df.join(to, c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")

        left = materialize(between(moved(moved(left, "a"), "b")), "edges")
        nodes = materialize(moved(nodes, "comp"), "components")
    return nodes
