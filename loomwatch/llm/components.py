"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomwatch.session import materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (a, b) reaches.

    Each round takes the smallest label among the neighbours and then that label's own label, so
    labels travel twice as far every round. Labels are written out every round; only the count of
    changes reaches the driver. A node with very many edges is a skewed join side, which adaptive
    execution splits, and a minimum that is taken before the shuffle.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct()
    both = materialize(both, "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
    labels = materialize(labels, "labels-0")
    for i in range(1, max_rounds + 1):
        heard = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("heard"))
        lower = labels.join(heard, "node", "left").select("node", "component", F.least("component", "heard").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("far"))
        after = lower.join(jump, "low", "left").select("node", F.least("low", "far").alias("component"), (F.least("low", "far") < F.col("component")).alias("moved"))
        after = materialize(after, f"labels-{i}")
        labels = after.select("node", "component")
        if after.where("moved").isEmpty():
            return labels
    raise RuntimeError(f"labels still move after {max_rounds} rounds")
