"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import cut, release


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges(a, b); label is the smallest node reachable.

    Each round every node takes the smallest label among its neighbours and then the label of
    that label, so chains halve. All rounds are joins and partial aggregates on long keys; only
    the number of changed nodes comes to the driver. An empty edge table gives an empty table.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")))
    last = labels
    while True:
        seen = labels.select(F.col("node").alias("b"), F.col("label").alias("seen"))
        near = both.join(seen, "b").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("near"))
        hooked = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = cut(hooked.join(jump, "label").select("node", "old", F.least("label", "further").alias("label")))
        release(last)
        labels, last = step.select("node", "label"), step
        if not step.where("old <> label").head(1):
            release(both)
            return labels
