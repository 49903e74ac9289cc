"""Connected components by contraction, with distributed tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.rows import freed, settled


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and label, the smallest id that edges (a, b) connect it with; ids are of any type that has an order.

    In each round every node hooks to its smallest neighbour, if that is smaller;
    pointer jumping takes it to the root; the edges between roots are the next graph.
    A round at least halves the nodes that still have edges.
    """
    left = settled(edges.filter(F.col("a") != F.col("b")).distinct())
    labels = nodes.select("id", F.col("id").alias("label"))
    while not left.isEmpty():
        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = settled(both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("p")))
        while True:
            above = parents.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            jumped = settled(parents.join(above, "p").select("a", "p", "pp"))
            moved = not jumped.filter(F.col("p") != F.col("pp")).isEmpty()
            parents = jumped.select("a", F.col("pp").alias("p"))
            if not moved:
                break
        root = lambda c: parents.select(F.col("a").alias(c), F.col("p").alias(f"{c}_root"))
        ends = left.join(root("a"), "a").join(root("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
        left = settled(ends.filter(F.col("a") != F.col("b")).distinct())
        labels = labels.join(parents.select(F.col("a").alias("label"), "p"), "label", "left").select("id", F.coalesce("p", "label").alias("label"))
        labels = settled(labels)
        freed(left)
    return labels
