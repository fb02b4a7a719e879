"""Connected components of a table of links, by smallest labels and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leasebook.llm.common import stage


def connected(links: DataFrame) -> DataFrame:
    """(node, label) for every end of a link (a, b); label is the smallest node it reaches.

    Each turn takes the smallest label among neighbours and then the label of that label, so the
    distance to the smallest node about halves. A turn's labels are written, and the next starts
    from them. Labels are unique per node, so a hub's links can be split over tasks.
    """
    both = stage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = stage(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("label")))
    while True:
        around = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("seen"))
        )
        lower = stage(
            labels.join(around, labels["node"] == around["a"])
            .select("node", F.least("label", "seen").alias("label"), F.col("label").alias("before"))
        )
        target = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = stage(lower.join(target, "label", "left").select("node", F.coalesce("next", "label").alias("label"), "before"))
        labels = jumped.select("node", "label")
        if jumped.where("label <> before").isEmpty():
            return labels
