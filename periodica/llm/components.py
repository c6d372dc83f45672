"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from periodica.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (a, b); the component is its smallest node.

    In each turn a node takes the smallest label around it, and then that label's own label,
    so that long chains halve.  Every turn is written to the shared folder.
    """
    both = links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct()
    both = staged(both, "links")
    labels = staged(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select(
            "node", F.least("node", "low").alias("component")
        ),
        "labels",
    )
    while True:
        around = (
            both.join(labels, both["b"] == labels["node"])
            .groupBy("a")
            .agg(F.min("component").alias("low"))
        )
        lower = labels.join(around, labels["node"] == around["a"]).select(
            "node", "component", F.least("component", "low").alias("low")
        )
        own = labels.select(F.col("node").alias("low"), F.col("component").alias("beyond"))
        turned = staged(
            lower.join(own, "low", "left").select(
                "node", "component", F.least("low", "beyond").alias("low")
            ),
            "labels",
        )
        labels = turned.select("node", F.col("low").alias("component"))
        if turned.where("low <> component").isEmpty():
            return labels
