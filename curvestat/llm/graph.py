"""Connected components by contraction, entirely in Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvestat.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """Node and root of each node of the undirected edges (a, b); both bigint.

    Every round each node takes the smallest of its neighbours and itself as
    parent, edges are replaced by those between parents, and loops and repeats
    are dropped; it ends when no edge is left. Rounds are logarithmic in the
    components' width for identifiers without order. Minima and repeats are
    partially aggregated before each shuffle. Nodes without an edge don't occur.
    """
    left = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    state = None
    while not left.isEmpty():
        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("up")))
        if state is None:
            state = parent.select("node", F.col("up").alias("root"))
        else:
            moved = parent.select(F.col("node").alias("at"), "up")
            state = cut(state.join(moved, F.col("root") == F.col("at"), "left").select("node", F.coalesce("up", "root").alias("root")))
        of_a = parent.select(F.col("node").alias("a"), F.col("up").alias("pa"))
        of_b = parent.select(F.col("node").alias("b"), F.col("up").alias("pb"))
        left = cut(
            left.join(of_a, "a").join(of_b, "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).filter("a <> b").distinct()
        )
    if state is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return state
