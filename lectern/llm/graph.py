"""Connected components by label propagation with pointer jumping; every round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges (a, b) -> (node, comp): comp is the smallest node reachable. Nodes without an edge are not in it."""
    both = scratch.table(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct())
    if not both.limit(1).count():
        none = both.select(F.col("a").alias("node"), F.col("b").alias("comp"))
        none._lectern_path = both._lectern_path
        return none
    labels = scratch.table(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("c")), "b").groupBy(F.col("a").alias("n")).agg(F.min("c").alias("c"))
        step = labels.join(near, F.col("node") == F.col("n")).select("node", F.col("comp").alias("old"), F.least("comp", "c").alias("comp"))
        jump = labels.select(F.col("node").alias("n"), F.col("comp").alias("c"))
        step = step.join(jump, F.col("comp") == F.col("n"), "left").select("node", "old", F.least("comp", F.coalesce("c", "comp")).alias("comp"))
        after = scratch.table(step)
        changed = after.filter("old <> comp").limit(1).count()
        scratch.drop(labels)
        labels = after.select("node", "comp")
        labels._lectern_path = after._lectern_path
        if not changed:
            scratch.drop(both)
            return labels
