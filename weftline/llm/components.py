"""Connected components of a table of links, by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.scratch import Scratch


def components(scratch: Scratch, name: str, links: DataFrame) -> tuple[DataFrame, str]:
    """(node, label) of every node of links(a, b), and the name of that table; label: the least node that can be reached.

    Each round takes the least label of the neighbours, then the label's label,
    so long chains halve. Hubs are harmless: minima are pre-aggregated, and the
    joins are between written tables, which adaptive execution can split.
    """
    both = scratch.write(f"{name}-edges", links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = scratch.write(f"{name}-0", both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    turn = 0
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        stepped = labels.join(near, "node").select("node", F.col("label").alias("before"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        turn += 1
        labels = scratch.write(f"{name}-{turn}", stepped.join(up, "label").select("node", "before", F.least("label", "up").alias("label")))
        scratch.drop(f"{name}-{turn - 1}")
        if labels.filter("label <> before").limit(1).count() == 0:
            scratch.drop(f"{name}-edges")
            return labels.select("node", "label"), f"{name}-{turn}"
        labels = labels.select("node", "label")
