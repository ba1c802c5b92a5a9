"""Connected components of a graph that is held as a table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftledger.llm.common import saved


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b); the root is the smallest node of the component.

    Each turn hangs the larger neighbours of every node, then the smaller ones, onto its smallest neighbour; a star is
    left when nothing changes, after a number of turns that grows with the logarithm of the nodes. Minima are taken
    before rows are shuffled, so a node with very many neighbours is no hot spot.
    """
    edges = saved(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("u < v").distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.filter("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).filter("u < v").distinct()
        small = large.groupBy("v").agg(F.min("u").alias("m"))
        linked = large.join(small, "v")
        hung = linked.filter("u > m").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(small.select("v", F.col("m").alias("u")))
        edges = saved(hung.distinct(), "edges")
        new = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if new == state or not new["n"]:
            roots = edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
            return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("u").alias("root")))
        state = new
