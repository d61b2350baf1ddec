"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in the edges (a, b); ids without edges are left out.

    Each round every node hooks to its smallest neighbour, hooks are followed twice, and the edges are rewritten
    between roots, so the edge table shrinks by a factor a round. A node with very many edges is one of many rows
    in every aggregate, which sums up before the shuffle.
    """
    live = stored(edges.filter(F.col("a") != F.col("b")).select("a", "b").distinct(), "edges")
    labels = stored(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("component", F.col("id")), "labels")
    while live.take(1):
        both = live.union(live.select("b", "a"))
        hooks = stored(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("n")).select("id", F.least("id", "n").alias("to")), "hooks")
        for _ in range(2):
            hooks = hooks.alias("x").join(hooks.alias("y"), F.col("x.to") == F.col("y.id")).select("x.id", "y.to")
        hooks = stored(hooks, "hooks")
        labels = stored(labels.join(hooks.withColumnRenamed("id", "component"), "component", "left").select(
            "id", F.coalesce("to", "component").alias("component")), "labels")
        at_a = live.join(hooks.select(F.col("id").alias("a"), F.col("to").alias("root_a")), "a")
        at_b = at_a.join(hooks.select(F.col("id").alias("b"), F.col("to").alias("root_b")), "b")
        live = stored(at_b.filter(F.col("root_a") != F.col("root_b")).select(
            F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct(), "edges")
    return labels
