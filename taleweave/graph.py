"""Connected parts of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taleweave.scratch import stored


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of long ids, loops for lone nodes -> ``(node, part)``: the smallest id reachable from each.

    Every node in turn sends its larger neighbours to the smallest one it has, then its smaller
    ones, until the edges are stars around the smallest of each part: some log of the nodes rounds,
    each with as many edges at most as the first. Only the number of changed edges is counted.
    """
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    links = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links")
    while True:
        both = links.union(links.select("lo", "hi")).toDF("node", "near")
        least = both.groupBy("node").agg(F.least("node", F.min("near")).alias("to"))
        large = stored(both.where("near > node").join(least, "node").select(F.col("near").alias("hi"), F.col("to").alias("lo")).where("hi <> lo").distinct(), "links")
        least = large.groupBy("hi").agg(F.min("lo").alias("to"))
        small = large.join(least, "hi").select(F.explode(F.array(F.struct("hi", F.col("to").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("to").alias("lo")))).alias("e")).select("e.hi", "e.lo")
        new = stored(small.where("hi <> lo").distinct(), "links")
        changed = new.join(links, ["hi", "lo"], "left_anti").isEmpty() and links.join(new, ["hi", "lo"], "left_anti").isEmpty()
        links = new
        if changed:
            break
    return nodes.join(links.toDF("node", "to"), "node", "left").select("node", F.coalesce("to", "node").alias("part"))
