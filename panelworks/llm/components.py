"""Connected components with DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.llm.common import durable


def min_labels(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, label): the smallest label in each node's component.

    ``links`` (a, b) are undirected, ``nodes`` (node, label) unique by node and by label. Each round takes the least label
    among the neighbours (a groupBy with map-side combine, so a hub is no hot spot), then follows the label's
    owner, which halves long chains. Rounds are checkpointed and end when no label changes.
    """
    both = durable(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    now = durable(nodes.select("node", "label", F.col("label").alias("own")))
    while True:
        told = both.join(now.select(F.col("node").alias("a"), "label"), "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("told"))
        met = now.join(told, "node", "left").select("node", "own", F.col("label").alias("was"), F.least("label", "told").alias("label"))
        owner = met.select(F.col("own").alias("label"), F.col("label").alias("owner_label"))
        nxt = met.join(owner, "label", "left").select("node", F.least("label", "owner_label").alias("label"), "own", "was")
        nxt = durable(nxt)
        changed = nxt.where("label < was OR (was IS NULL AND label IS NOT NULL)").limit(1).count()
        now = nxt.select("node", "label", "own")
        if not changed:
            return now.select("node", "label")
