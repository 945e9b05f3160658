"""Connected components of a large edge list by rounds of hooking to the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.session import cut_and_count, cut_lineage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`node` and `root` (the smallest node reached from it) for every node of the undirected edges (two
    longs, not null). Each round points every node to its smallest neighbour, if smaller, and contracts
    the edges; the number of nodes at least halves, so rounds grow with the logarithm of the longest path.
    A node with very many edges is summed up by partial aggregation."""
    edges, left = cut_and_count(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    rounds = []
    while left or not rounds:
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        parents = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(
            F.min("b").alias("least")).select("node", F.least("node", "least").alias("root")))
        rounds.append(parents)
        to_a = parents.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        to_b = parents.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges, left = cut_and_count(
            edges.join(to_a, "a").join(to_b, "b").where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    found = rounds[0]
    for later in rounds[1:]:
        step = later.select(F.col("node").alias("root"), F.col("root").alias("next"))
        found = found.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return cut_lineage(found)
