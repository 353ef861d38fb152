"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinarm.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of the links (a, b); root is the least node of its component.

    Each step takes the least label among neighbours and then the label of that label,
    so paths shorten fast. Labels are written as a table after each step; only the
    number of changed labels comes to the driver.
    """
    both = written(
        links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            links.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct(), "links")
    labels = written(both.groupBy("node").agg(F.min("other").alias("root")).select("node", F.least("node", "root").alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "root"), "other").groupBy("node").agg(F.min("root").alias("near"))
        moved = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("root").alias("far"))
        stepped = written(moved.join(jump, "next").select("node", F.least("next", "far").alias("root"), (F.least("next", "far") != F.col("root")).alias("changed")), "labels")
        labels = stepped.select("node", "root")
        if stepped.where("changed").isEmpty():
            return labels
