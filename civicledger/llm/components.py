"""Connected components of an edge table, by hooking and pointer jumping; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, small


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for all nodes of (a, b), comp being one of the component's nodes.

    Every node that has a smaller neighbour hooks onto the smallest of them; jumps make all trees stars; edges
    are mapped to roots, and what isn't a loop goes round again. Each round at least halves the roots that have
    edges left. A node of very many edges is a group that is summed up before the shuffle (its least neighbour)
    or the skewed side of a join by its own key.
    """
    pair = lambda e: e.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    left, labels = cut(pair(edges), "cc-edges"), None
    most = left.count()
    while labels is None or not left.isEmpty():
        tree = cut(left.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")), "cc-tree", most)
        while True:
            above = small(tree).select(F.col("node").alias("up"), F.col("up").alias("top"))
            once = tree.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up"))
            # a second jump over the same table shows whether all are at their roots
            twice = once.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved"))
            jumped = cut(twice, "cc-tree", most)
            drop(tree)
            tree = jumped.select("node", "up")
            tree._table = jumped._table
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            ends = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
            labels = cut(ends.join(small(tree), "node", "left").select("node", F.coalesce("up", "node").alias("comp")), "cc-labels", 2 * most)
        else:
            step = small(tree).select(F.col("node").alias("comp"), "up")
            before, labels = labels, cut(labels.join(step, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp")), "cc-labels", 2 * most)
            drop(before)
        was, root = left, small(tree)
        for end in ("a", "b"):
            left = left.join(root.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("up", end)).drop("up")
        left = cut(pair(left), "cc-edges", most)
        drop(was, tree)
    drop(left)
    return labels
