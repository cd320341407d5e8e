"""Connected components of link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, materialize


def components(links: DataFrame) -> DataFrame:
    """(node, label) of links (a, b): label is the smallest node that links reach.

    Each round takes the smallest label among a node's neighbours and then that label's own, so that chains shrink by
    halves; rounds are tables in the shared folder. Partial aggregates spread a node with very many links.
    """
    with Scratch(links.sparkSession) as keep:
        both = keep(links.union(links.select("b", "a")).toDF("node", "other").distinct(), "links")
        labels = keep(both.groupBy("node").agg(F.min(F.least("node", "other")).alias("label")), "labels")
        while True:
            near = both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("seen")), "other").groupBy("node").agg(F.min("seen").alias("seen"))
            step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
            jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
            found = keep(step.join(jump, "label").select("node", "old", F.least("label", "further").alias("label")), "labels")
            if found.where(F.col("old") != F.col("label")).isEmpty():
                return materialize(found.select("node", "label"), "component-labels")
            labels = found.select("node", "label")
