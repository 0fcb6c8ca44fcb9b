"""Connected components of star edges, by smallest labels with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfield.llm.stage import stored


def components(stars: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component of ``stars`` (node, hub), every hub being a node of its own star.

    Each round takes the minimum over the members of a star, over the stars of a member, and then the label
    of the label, so the rounds follow the logarithm of the longest chain. A hub with very many members
    costs one partial minimum per task. An empty frame gives an empty result.
    """
    stars = stored(stars.distinct(), "stars")
    labels = stored(stars.groupBy("node").agg(F.min("hub").alias("label")), "labels")
    while True:
        hubs = stars.join(labels, "node").groupBy("hub").agg(F.min("label").alias("least"))
        lower = stars.join(hubs, "hub").groupBy("node").agg(F.min("least").alias("least"))
        after = lower.alias("a").join(lower.select(F.col("node").alias("least"), F.col("least").alias("next")), "least", "left")
        new = stored(
            after.join(labels.withColumnRenamed("label", "old"), "node").select("node", F.least("old", "least", F.coalesce("next", "least")).alias("label"), "old"),
            "labels",
        )
        changed = new.where(F.col("label") != F.col("old")).limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
