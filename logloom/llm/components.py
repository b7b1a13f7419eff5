"""Connected components by joins: the smallest node that each node reaches."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.checkpoints import materialize


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of the nodes in ``links`` (a, b).

    Each round takes the smallest label among a node and its neighbours, then the label of that label, so the number of
    rounds grows with the logarithm of a component's width. Labels are tables in the shared folder; nothing is collected.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    edges = materialize(both.distinct(), "links")
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")), "labels")
    while True:
        of = labels.select(F.col("node").alias("b"), F.col("component").alias("near"))
        near = edges.join(of, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        lower = materialize(labels.join(near, "node").select("node", "component", F.least("component", "near").alias("lower")), "labels")
        above = lower.select(F.col("node").alias("lower"), F.col("lower").alias("lowest"))
        after = materialize(
            lower.join(above, "lower").select("node", F.least("lower", "lowest").alias("component"), F.col("component").alias("old")), "labels"
        )
        if after.where("component <> old").isEmpty():
            return after.select("node", "component")
        labels = after.select("node", "component")
