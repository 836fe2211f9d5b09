"""Connected components of an edge table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taleweave.llm.scratch import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of long ids -> ``(id, component)``: the smallest id reachable from each node.

    Each round points every node at its smallest neighbour, follows the pointers to their
    roots by doubling, and contracts the graph to those roots. A round at least halves the
    nodes, so the rounds grow with the logarithm of the longest chain. Nothing is collected
    but row counts. No edges: an empty result. Null ends and self loops are ignored.
    """
    edges = stored(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a <> b").distinct(),
        "edges",
    )
    labels = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("id"), F.col("b").alias("to")).union(edges.select(F.col("b"), F.col("a")))
        step = stored(both.groupBy("id").agg(F.least("id", F.min("to")).alias("component")), "step")
        while True:
            up = step.select(F.col("id").alias("component"), F.col("component").alias("root"))
            jumped = step.join(up, "component").select("id", F.col("root").alias("component"), (F.col("root") != F.col("component")).alias("moved"))
            jumped = stored(jumped, "step")
            moved = not jumped.where("moved").isEmpty()
            step = jumped.select("id", "component")
            if not moved:
                break
        if labels is None:
            labels = step
        else:
            onward = step.select(F.col("id").alias("component"), F.col("component").alias("root"))
            labels = labels.join(onward, "component", "left").select("id", F.coalesce("root", "component").alias("component"))
            labels = stored(labels, "labels")
        ends_a = step.select(F.col("id").alias("a"), F.col("component").alias("ra"))
        ends_b = step.select(F.col("id").alias("b"), F.col("component").alias("rb"))
        edges = stored(
            edges.join(ends_a, "a").join(ends_b, "b").where("ra <> rb")
            .select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct(),
            "edges",
        )
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return labels
