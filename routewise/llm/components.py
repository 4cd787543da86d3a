"""Connected components by hooking and contraction, on Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routewise.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of the edges (a, b): comp is the smallest node that it reaches.

    Each round hooks every root to its smallest neighbour, follows the hooks, and contracts the edges;
    the number of rounds grows with the logarithm of the longest path.  Roots are grouped with partial
    aggregation, and every join has one row per root on one side, so a root with very many edges can be
    split over tasks.  Only the count of the remaining edges reaches the driver.
    """
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("comp"))
    if edges.isEmpty():
        return labels
    while True:
        hooks = edges.groupBy(F.col("b").alias("root")).agg(F.min("a").alias("to"))
        hooks = written(hooks, "hooks")
        for _ in range(2):
            onward = hooks.select(F.col("root").alias("to"), F.col("to").alias("next"))
            hooks = hooks.join(onward, "to", "left").select("root", F.coalesce("next", "to").alias("to"))
        hooks = written(hooks, "hooks")
        labels = written(labels.join(hooks, labels["comp"] == hooks["root"], "left")
                         .select("node", F.coalesce("to", "comp").alias("comp")), "labels")
        for side in ("a", "b"):
            edges = edges.join(hooks.select(F.col("root").alias(side), "to"), side, "left").withColumn(
                side, F.coalesce("to", side)).drop("to")
        edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
        if edges.isEmpty():
            return labels
