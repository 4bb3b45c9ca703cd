"""Cycles and walks on an edge table (src, dst, amount)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import first_by


def cycles(edges: DataFrame, length: int) -> DataFrame:
    """Directed simple cycles of `length` nodes, each once, its least node first: n0.., leg0.., min_leg, total.

    The order is applied before each join, so that only paths that can still be canonical are extended. Cycles of four
    are two halves of two edges each that end in the cycle's node of the highest degree (ties by name) and in the node
    across from it: no half runs through a hub, and their number is at most edges^1.5.
    """
    e = edges.where("src != dst")
    legs = [F.col(f"leg{i}") for i in range(length)]
    columns = [*[f"n{i}" for i in range(length)], *[f"leg{i}" for i in range(length)], "min_leg", "total_circled"]
    if length == 4:
        degree = e.select(F.col("src").alias("node")).unionAll(e.select("dst")).groupBy("node").agg(F.count("*").alias("d"))
        for end in ("src", "dst"):
            e = e.join(degree.select(F.col("node").alias(end), F.struct("d", "node").alias(f"r_{end}")), end)
        step = lambda a, b, leg: e.select(F.col("src").alias(a), F.col("dst").alias(b), F.col("r_src").alias(f"r_{a}_"), F.col("r_dst").alias(f"r_{b}_"), F.col("amount").alias(leg))
        there = step("top", "b", "l0").where("r_b_ < r_top_").drop("r_b_").join(step("b", "y", "l1").drop("r_b_"), "b").where("r_y_ < r_top_").drop("r_y_", "r_top_")
        back = step("d", "top", "l3").where("r_d_ < r_top_").drop("r_d_").join(step("y", "d", "l2").drop("r_d_"), "d").where("r_y_ < r_top_").drop("r_y_", "r_top_")
        met = there.join(back, ["top", "y"]).where("b != d")
        nodes, amounts = F.array("top", "b", "y", "d"), F.array("l0", "l1", "l2", "l3")
        first = F.array_position(nodes, F.array_min(nodes)).cast("int") - 1
        turned = met.select(*[F.get(x, (first + i) % 4).alias(f"{name}{i}") for x, name in ((nodes, "n"), (amounts, "leg")) for i in range(4)])
        return turned.withColumn("min_leg", F.least(*legs)).withColumn("total_circled", reduce(lambda a, b: a + b, legs)).select(*columns)
    paths = e.where("src < dst").select(F.col("src").alias("n0"), F.col("dst").alias("n1"), F.col("amount").alias("leg0"))
    for i in range(1, length - 1):
        step = e.select(F.col("src").alias(f"n{i}"), F.col("dst").alias(f"n{i + 1}"), F.col("amount").alias(f"leg{i}"))
        fresh = reduce(lambda a, b: a & b, [F.col(f"n{i + 1}") != F.col(f"n{j}") for j in range(1, i + 1)])
        paths = paths.join(step, f"n{i}").where((F.col(f"n{i + 1}") > F.col("n0")) & fresh)
    last = length - 1
    back = e.select(F.col("src").alias(f"n{last}"), F.col("dst").alias("n0"), F.col("amount").alias(f"leg{last}"))
    out = paths.join(back, [f"n{last}", "n0"])
    out = out.withColumn("min_leg", F.least(*legs)).withColumn("total_circled", reduce(lambda a, b: a + b, legs))
    return out.select(*columns)


def reciprocal(edges: DataFrame) -> DataFrame:
    """Pairs with edges both ways, once: n0 < n1, leg0, leg1."""
    back = edges.select(F.col("src").alias("n1"), F.col("dst").alias("n0"), F.col("amount").alias("leg1"))
    return edges.where("src < dst").select(F.col("src").alias("n0"), F.col("dst").alias("n1"), F.col("amount").alias("leg0")).join(back, ["n0", "n1"])


def largest_edge_walk(edges: DataFrame, starts: DataFrame, hops: int = 2) -> DataFrame:
    """From each start (column node), follow the largest edge `hops` times at most; a walk ends on a node it has seen.

    (start, hop, src, dst, amount), a row for each step: `hops` joins, each of one row for each walk.
    """
    best = first_by(edges, ["src"], ["dst", "amount"], F.struct(-F.col("amount"), F.col("dst")))
    walk = starts.select(F.col("node").alias("start"), F.col("node").alias("src"), F.array("node").alias("seen"))
    steps = []
    for hop in range(1, hops + 1):
        walk = walk.join(best, "src")
        steps.append(walk.select("start", F.lit(hop).alias("hop"), "src", "dst", "amount"))
        walk = walk.where(~F.array_contains("seen", F.col("dst"))).select("start", F.col("dst").alias("src"), F.array_append("seen", F.col("dst")).alias("seen"))
    return reduce(DataFrame.unionByName, steps)
