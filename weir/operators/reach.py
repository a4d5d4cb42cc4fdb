"""What a graph's nodes reach. edges: (parent, child), cycles allowed; each round is written and only new rows go on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.sources.kept import kept


def closure(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, node) for all nodes that a root reaches, itself too."""
    seen = frontier = kept(roots.select("root", F.col("root").alias("node")).distinct())
    while not frontier.isEmpty():
        step = frontier.join(edges, F.col("node") == F.col("parent")).select("root", F.col("child").alias("node")).distinct()
        frontier = kept(step.join(seen, ["root", "node"], "left_anti"))
        seen = seen.union(frontier)
    return seen


def reached(start: DataFrame, edges: DataFrame) -> DataFrame:
    """(node) for all nodes that any of start (node) reaches, those too: one row a node, whoever reaches it."""
    seen = frontier = kept(start.select("node").distinct())
    while not frontier.isEmpty():
        step = frontier.join(edges, F.col("node") == F.col("parent")).select(F.col("child").alias("node")).distinct()
        frontier = kept(step.join(seen, "node", "left_anti"))
        seen = seen.union(frontier)
    return seen


def reaching(ends: DataFrame, edges: DataFrame) -> DataFrame:
    """(node) for all nodes that reach any of ends (node), those too."""
    return reached(ends, edges.select(F.col("child").alias("parent"), F.col("parent").alias("child")))
