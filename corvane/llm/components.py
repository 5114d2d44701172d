"""Connected components of an undirected graph by repeated contraction, entirely in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.runtime import drop_materialised, materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> ``(node, component)``: the smallest node that each node of an edge reaches.

    In each round every node takes as parent the node of its closed neighbourhood that comes first in a
    random order drawn anew for the round, then its parent's parent; edges are rewritten to parents and
    deduplicated, so the graph shrinks by a constant factor a round, chains and stars alike. Loops, repeated
    edges and rows with a null end have no effect on the result. The joins read materialised tables, so
    adaptive execution can split a node with very many edges.
    """
    live = materialise(edges.select("a", "b").filter("a <> b").distinct())
    steps: list[DataFrame] = []
    first = live
    while not live.isEmpty():
        order = lambda c, r=len(steps): F.xxhash64(F.col(c), F.lit(r))
        both = live.union(live.select("b", "a"))
        nearest = both.groupBy("a").agg(F.min_by("b", order("b")).alias("b"))
        parent = materialise(nearest.select(F.col("a").alias("node"), F.when(order("a") < order("b"), F.col("a")).otherwise(F.col("b")).alias("up")))
        above = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
        jumped = materialise(parent.join(above, "up").select("node", F.col("top").alias("up")))
        drop_materialised(parent)
        a_up = jumped.select(F.col("node").alias("a"), F.col("up").alias("pa"))
        b_up = jumped.select(F.col("node").alias("b"), F.col("up").alias("pb"))
        shrunk = materialise(
            live.join(a_up, "a").join(b_up, "b").filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        )
        if live is not first:
            drop_materialised(live)
        live = shrunk
        steps.append(jumped)
    nodes = first.select(F.col("a").alias("node")).union(first.select("b")).distinct().withColumn("root", F.col("node"))
    for step in steps:
        up = step.select(F.col("node").alias("root"), F.col("up").alias("next"))
        nodes = nodes.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    nodes = materialise(nodes)
    for step in [first, *steps]:
        drop_materialised(step)
    smallest = materialise(nodes.groupBy("root").agg(F.min("node").alias("component")))
    return nodes.join(smallest, "root").select("node", "component")
