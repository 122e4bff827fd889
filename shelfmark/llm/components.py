"""Connected components of a graph of links, by smallest label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.session import stage


def connected_components(links: DataFrame) -> DataFrame:
    """``node``, ``label`` of every node in ``links`` (``a``, ``b``): the smallest node that it reaches.

    A round takes the smallest label among the neighbours, then the label of that label, so
    long chains need few rounds.  Every round is written to the shared folder: nothing is
    recomputed when an executor is lost, and only a count comes to the driver.
    """
    links = links.select("a", "b").filter("a <> b")
    edges = stage(links.union(links.select("b", "a")).toDF("a", "b").distinct(), "edges")
    labels = stage(edges.groupBy("a").agg(F.min("b").alias("near")).select(F.col("a").alias("node"), F.least("a", "near").alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        lower = stage(lower, "lower")
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = stage(lower.join(jump, "label", "left").select("node", "was", F.least("label", "further").alias("label")), "labels")
        changed = after.filter("label <> was").limit(1).count()
        labels = after.select("node", "label")
        if not changed:
            return labels
