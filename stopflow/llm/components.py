"""Connected components of a link table by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, saved


def components(links: DataFrame) -> DataFrame:
    """(a, b) links to (node, component): the smallest node reachable; only linked nodes are returned.

    Each round takes the smallest label among the neighbours, then the label of that label, so paths
    halve; a round is written to the shared folder, and the loop ends when no label changes.
    """
    both = saved(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links"
    )
    labels = table = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = (
            both.join(labels.withColumnsRenamed({"node": "b", "component": "seen"}), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("seen").alias("seen"))
        )
        step = saved(
            labels.join(near, "node").select("node", "component", F.least("component", "seen").alias("to")), "step"
        )
        jump = step.select(F.col("node").alias("to"), F.col("to").alias("further"))
        after = saved(step.join(jump, "to").select("node", "component", F.col("further").alias("to")), "labels")
        done = after.filter("component <> to").isEmpty()
        forget(step, table)
        if done:
            forget(both)
            return after.select("node", "component")
        table, labels = after, after.select("node", F.col("to").alias("component"))
