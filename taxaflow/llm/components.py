"""Connected components of a table of links, by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaflow.session import staged


def components(links: DataFrame) -> DataFrame:
    """Rows (node, component) for every node of ``links`` (a, b); the component is its least node.

    Every round passes the least label along links and then takes the label of the label, so chains
    shorten by more than half. Rounds are staged and end when nothing changes.
    """
    both = links.where("a <> b").select("a", "b").union(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = staged(both.distinct())
    labels = staged(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("component")).select(F.col("a").alias("node"), "component"))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        passed = labels.join(near, labels["node"] == near["a"]).select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        passed = staged(passed)
        parents = passed.select(F.col("node").alias("parent"), F.col("component").alias("grand"))
        jumped = passed.join(parents, passed["component"] == parents["parent"]).select("node", "old", F.least("component", "grand").alias("component"))
        jumped = staged(jumped)
        labels = jumped.select("node", "component")
        if not jumped.where("component <> old").limit(1).count():
            return labels
