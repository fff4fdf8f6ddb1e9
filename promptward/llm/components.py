"""Connected components of a link table, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptward.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """Label every node of (a, b) links with the least node of its component: node, label.

    Each round gives a node the least label around it and then follows that label
    one step further, so labels travel twice as far every time.  A hub with many
    links is one row per neighbour and task before the minimum is shuffled.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other"))
    both = written(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "links")
    labels = written(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("other"), "label"), "other").select("node", "label", F.lit(None).alias("old"))
        own = labels.select("node", "label", F.col("label").alias("old"))
        least = around.unionByName(own).groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        lower = written(least, "labels")
        up = lower.select(F.col("node").alias("label"), F.col("label").alias("top"))
        jumped = lower.join(up, "label", "left").select("node", F.least("label", F.coalesce("top", "label")).alias("label"), "old")
        jumped = written(jumped, "labels")
        if jumped.filter("label != old").isEmpty():
            return jumped.select("node", "label")
        labels = jumped.select("node", "label")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` of ``components`` after more (a, b) links: only links between components go through its rounds."""
    of = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    ends = written(ends.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")).filter("a != b").distinct(), "links")
    if ends.isEmpty():
        return labels
    tops = components(ends).select(F.col("node").alias("label"), F.col("label").alias("top"))
    lifted = labels.join(tops, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    fresh = tops.withColumnRenamed("label", "node").join(labels, "node", "left_anti").select("node", F.col("top").alias("label"))
    return written(lifted.unionByName(fresh), "labels")
