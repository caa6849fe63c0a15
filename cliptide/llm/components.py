"""Connected components of an edge table by label spreading and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliptide.llm._common import Scratch, hot_join


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) -> (node, label): label is the smallest node that node reaches.

    Every round takes the smallest label among a node and its neighbours, then
    replaces each label by its own label, so the rounds grow with the logarithm
    of a component's diameter. Each round's labels are written to the shared
    folder. A node of many neighbours is dealt over tasks. Loops and repeated
    edges are harmless; null ends are dropped; no edges give no rows.
    """
    edges = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = scratch.save(edges.select("a", F.col("b").alias("node")).union(edges.select("b", "a")).distinct())
    labels = scratch.save(both.groupBy("a").agg(F.min("node").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label")))
    while True:
        seen = hot_join(both, labels, "node").groupBy("a").agg(F.min("label").alias("near"))
        spread = scratch.save(
            labels.join(seen.hint("merge"), F.col("node") == F.col("a")).select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        )
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        jumped = scratch.save(hot_join(spread, up, "label").select("node", F.least("label", "top").alias("label"), "old"))
        changed = not jumped.filter("label <> old").isEmpty()
        scratch.drop(labels, spread)
        labels = jumped.drop("old")
        labels._cliptide_path = jumped._cliptide_path
        if not changed:
            scratch.drop(both)
            return labels
