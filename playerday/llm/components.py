"""Connected components of an edge table, as joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playerday.llm.common import discard, materialise


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(src, dst); component is the smallest node reachable.

    Each round takes the least label among the neighbours, hooks it onto the
    node and onto the node's present root, then shortcuts label to label of
    label, so that the rounds grow with the logarithm of a chain's length.
    Every join reads two written tables, which lets adaptive execution split
    a hub's partition; every minimum is combined before its shuffle. Repeated
    edges, loops and an empty table are fine; a null end drops the edge.
    """
    one_way = edges.select("src", "dst").where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    both = materialise(one_way.union(one_way.select("dst", "src")).distinct(), "cc-edges")
    labels = both.groupBy(F.col("src").alias("node")).agg(F.min(F.least("src", "dst")).alias("component"))
    labels = materialise(labels, "cc-labels")
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        seen = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("least"))
        hooked = seen.select("node", "least").union(seen.select("component", "least")).groupBy("node").agg(F.min("least").alias("component"))
        hooked = materialise(hooked, "cc-hooked")
        root = hooked.select(F.col("node").alias("component"), F.col("component").alias("root"))
        jumped = materialise(hooked.join(root, "component").select("node", F.col("root").alias("component")), "cc-labels")
        moved = jumped.join(labels.withColumnRenamed("component", "before"), "node").where("component <> before").limit(1).count()
        discard(hooked)
        discard(labels)
        labels = jumped
        if not moved:
            discard(both)
            return labels
    raise RuntimeError(f"labels still move after {max_rounds} rounds")
