"""Connected components by alternating large-star and small-star rounds, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop, settle


def _stars(edges: DataFrame) -> bool:
    """Whether edges (u > v) are stars already: each u has one v, which is no u itself."""
    ends = edges.selectExpr("u as node", "1L as up", "0L as down").union(edges.selectExpr("v as node", "0L as up", "1L as down"))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of `edges`; root is the least node of its component.

    Nodes may be of any ordered type; null ends, loops and repeated edges are ignored, no edges give no rows. Each
    round takes the least neighbour by a partial aggregate and joins it back, so a node with a third of all edges
    costs no task of its own (the join splits it), and the edges are settled after each round. Rounds end with the first
    that leaves stars, or before the first if the edges are stars.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u != v").distinct()
    now = settle(now, "edges")
    for _ in range(most_rounds):
        if _stars(now):
            break
        ends = now.union(now.selectExpr("v as u", "u as v")).groupBy("u").agg(F.min("v").alias("m"))
        # Large star: each node's larger neighbours move to the least of the node and its neighbours.
        large = now.join(ends.select(F.col("u").alias("v"), F.least("u", "m").alias("m")), "v").selectExpr("u", "m as v").distinct()
        # Small star: so do its smaller neighbours, and the node itself.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").selectExpr("v as u", "m as v").union(low.selectExpr("u", "m as v")).distinct()
        before, now = now, settle(small, "edges")
        drop(before)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
