"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewfold.llm.common import stored


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """``(node, root)`` for every node of ``links (a, b)``; root is the smallest
    node that can be reached.

    Alternates large-star and small-star steps (Kiveris et al., 2014). Every
    step sends each node's neighbours to the smallest one it knows, by an
    aggregate and a join on the node, and is written down, so lineage stays
    short. The number of steps grows with the logarithm of the graph's size.
    """
    edges = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi <> lo").distinct()
    edges = stored(edges, name)
    while True:
        # Large star: neighbours above a node are linked to its smallest neighbour.
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # Small star: a node and its smaller neighbours are linked to the smallest.
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(down, "hi")
            .select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo"))
            .filter("hi <> lo")
            .distinct()
        )
        fresh = stored(small, name)
        # Done when every node has one parent and no parent has a parent.
        parents = fresh.groupBy("hi").agg(F.count(F.lit(1)).alias("n"))
        split = parents.filter("n > 1").limit(1).count()
        chained = fresh.select(F.col("lo").alias("hi")).distinct().join(parents, "hi", "left_semi").limit(1).count()
        edges = fresh
        if not split and not chained:
            break
    roots = edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionAll(roots)
