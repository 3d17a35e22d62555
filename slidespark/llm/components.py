"""Connected components of an edge table, by contraction; nothing is gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_empty, staged


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for all nodes of edges (a, b: long).

    Each round hooks every node to its smallest neighbour if that is smaller, follows the hooks twice, and replaces the ends
    of edges by what they hang on; edges within a component vanish, so tables shrink each round.  Nodes with very many edges
    are aggregated with partial sums and joined by joins that Spark can split.
    """
    edges = staged(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = staged(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("component", F.col("node")), "labels")
    while not is_empty(edges):
        # only the larger end of an edge is hooked
        hooks = staged(edges.groupBy(F.col("b").alias("n")).agg(F.min("a").alias("up")), "hooks")
        for _ in range(2):
            above = hooks.select(F.col("n").alias("up"), F.col("up").alias("top"))
            hooks = staged(hooks.join(above, "up", "left").select("n", F.coalesce("top", "up").alias("up")), "hooks")
        labels = staged(labels.join(hooks.select(F.col("n").alias("component"), "up"), "component", "left").select("node", F.coalesce("up", "component").alias("component")), "labels")
        for end in ("a", "b"):
            edges = edges.join(hooks.select(F.col("n").alias(end), "up"), end, "left").withColumn(end, F.coalesce("up", end)).drop("up")
        edges = staged(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return labels
