"""Connected components within groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.storage import cut_lineage


def components(edges: DataFrame, key: str, a: str = "a", b: str = "b") -> DataFrame:
    """(key, node, component): the smallest node that each node of edges(key, a, b) reaches within its key.

    Each node points to its smallest neighbour or itself and pointers are followed to their ends by doubling;
    the edges between ends go the same way until none is left. A round at least halves the nodes, so the rounds
    are the logarithm of the largest component, however long its arms are.
    """
    left = cut_lineage(edges.select(key, F.col(a).alias("a"), F.col(b).alias("b")).distinct())
    out = None
    while out is None or not left.isEmpty():
        both = left.select(key, F.col("a").alias("node"), F.col("b").alias("o")).unionAll(left.select(key, "b", "a"))
        ends = cut_lineage(both.groupBy(key, "node").agg(F.min("o").alias("o")).select(key, "node", F.least("node", "o").alias("end")))
        moved = True
        while moved:
            further = ends.select(key, F.col("node").alias("end"), F.col("end").alias("far"))
            then = cut_lineage(ends.join(further, [key, "end"]).select(key, "node", F.col("far").alias("end"), (F.col("far") != F.col("end")).alias("moved")))
            moved, ends = not then.where("moved").isEmpty(), then.drop("moved")
        drawn = left.join(ends.select(key, F.col("node").alias("a"), F.col("end").alias("x")), [key, "a"]).join(ends.select(key, F.col("node").alias("b"), F.col("end").alias("y")), [key, "b"])
        left = cut_lineage(drawn.where("x <> y").select(key, F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        if out is None:
            out = ends.select(key, "node", F.col("end").alias("component"))
        else:
            out = out.join(ends.select(key, F.col("node").alias("component"), "end"), [key, "component"], "left").select(key, "node", F.coalesce("end", "component").alias("component"))
    return out
