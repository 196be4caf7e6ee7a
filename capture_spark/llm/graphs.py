"""Connected components over link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capture_spark.llm.tables import settled, stored


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for each node of ``links`` (a, b); comp is the smallest node reachable.

    Each round takes the smallest label among a node and its neighbours, then
    the label of that label, and is written to the shared folder; it ends when
    no label changes.  Labels are minima, so a node with very many links is
    summed up before the shuffle.
    """
    return settled(links.sparkSession, "components", lambda: _labels(links))


def _labels(links: DataFrame) -> DataFrame:
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("comp"))
    labels = stored(labels, "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("low"))
        near = labels.join(near, labels["node"] == near["a"]).select("node", F.col("comp").alias("was"), F.least("comp", "low").alias("comp"))
        up = labels.select(F.col("node").alias("up_node"), F.col("comp").alias("up_comp"))
        new = near.join(up, near["comp"] == up["up_node"], "left").select("node", "was", F.least("comp", "up_comp").alias("comp"))
        new = stored(new, "labels")
        changed = new.filter("was <> comp").limit(1).count()
        labels = new.select("node", "comp")
        if not changed:
            return labels
