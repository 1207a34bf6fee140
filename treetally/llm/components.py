"""Connected components by hooking and pointer jumping on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import lookup
from .common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node of its component.

    Each round, every root hooks onto its smallest neighbour, chains are followed to their
    ends by pointer jumping, and edges are renamed to the roots; edges inside a component go.
    What is left shrinks each round. A root that very many nodes or edges have is dealt to
    several tasks. Nulls and self loops are ignored; no edges, no rows."""
    edges = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    roots = written(edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct().withColumn("root", F.col("node")), "roots")
    while True:
        both = edges.union(edges.select("b", "a"))
        hooks = both.groupBy("a").agg(F.min("b").alias("to")).where("to < a").select(F.col("a").alias("root"), "to")
        hooks = written(hooks, "hooks")
        if hooks.isEmpty():
            return roots
        while True:
            far = hooks.select(F.col("root").alias("to"), F.col("to").alias("further"))
            jumped = written(hooks.join(far, "to", "left").select("root", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")), "hooks")
            hooks = jumped.select("root", "to")
            if jumped.where("moved").isEmpty():
                break
        roots = written(lookup(roots, hooks, "root", F.col("node")).select("node", F.coalesce("to", "root").alias("root")), "roots")
        for side in ("a", "b"):
            other = "b" if side == "a" else "a"
            edges = lookup(edges, hooks.select(F.col("root").alias(side), F.col("to").alias(f"{side}_to")), side, F.col(other)).withColumn(side, F.coalesce(f"{side}_to", side)).select("a", "b")
        edges = written(edges.where("a <> b").distinct(), "edges")
