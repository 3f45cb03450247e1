"""Connected components of links, by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changefeed.session import discard, written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of ``links`` (a, b); the component is the smallest node that can be reached.

    Each round takes the smallest label among a node's neighbours and then that label's own label, so labels travel a distance that
    doubles with each round. Labels of a round are written to the shared folder. Nodes may be of any type with an order;
    links with a null end are left out. Both joins have one row for each node on one side, so a hot node's other side can be split.
    """
    both = links.where("a is not null and b is not null").select("a", "b")
    both = written(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("component")), "labels")
    last = labels
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("beyond"))
        after = written(
            step.join(jump, "to", "left").select("node", "was", F.least("to", "beyond").alias("component")), "labels"
        )
        discard(last)
        labels, last = after.select("node", "component"), after
        if not after.where("was != component").limit(1).count():
            discard(both)
            return labels
