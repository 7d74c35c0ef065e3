"""Connected components of a table of links, without gathering a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sensorframe.plans.sizing import store


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of ``edges``; the root is the smallest node of its component.

    Each round hooks every node onto the smallest label around it and then jumps twice along the
    labels, so that chains shrink by a factor per round.  A round stores its labels; links
    between nodes of one label are dropped.  Only grouped aggregates and equi-joins are used.
    """
    links = store(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct())
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    labels = store(nodes.withColumn("root", F.col("node")))
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("least"))  # per current label
        hook = store(least.select(F.col("a").alias("node"), F.least("a", "least").alias("up")))
        for _ in range(2):
            up = hook.select(F.col("node").alias("up"), F.col("up").alias("upper"))
            hook = hook.join(up, "up", "left").select("node", F.coalesce("upper", "up").alias("up"))
        hook = store(hook)
        to = hook.select(F.col("node").alias("root"), "up")
        labels = store(labels.join(to, "root", "left").select("node", F.coalesce("up", "root").alias("root")))
        left = hook.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        right = hook.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        links = store(
            links.join(left, "a")
            .join(right, "b")
            .select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b"))
            .filter("a <> b")
            .distinct()
        )
    return labels
