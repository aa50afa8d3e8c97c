"""Connected components by alternating star contraction (Kiveris et al., 2014) on DataFrames.

Each half-step is one shuffle of the edges, and rounds end as soon as the edges are stars. Every node is linked to the smallest
node known in its neighbourhood, so a chain of n nodes needs about log n rounds, not n. A node with very many neighbours is pre-aggregated map-side (``min``), and its
neighbour rows are split by AQE's skew join; no neighbour list is ever built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimsieve.plans.storage import delete_path, new_path


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Rows ``(node, component)`` for every node that has an edge; ``component`` is the smallest node reachable.

    Edges are undirected. Repeated edges, self loops and edges with a NULL end are allowed and add nothing (a node
    whose only edges are self loops is left out). An empty table gives an empty table.
    """
    spark = edges.sparkSession
    a, b = F.col(src).alias("_a"), F.col(dst).alias("_b")
    first = edges.select(a, b).where("_a is not null and _b is not null and _a <> _b").select(F.greatest("_a", "_b").alias("u"), F.least("_a", "_b").alias("v")).distinct()
    path = new_path(spark, "components")
    first.write.parquet(path)  # each round reads the edges more than once
    cur = spark.read.schema(first.schema).parquet(path)
    while not _is_stars(cur):
        new = new_path(spark, "components")
        small = _small_star(_large_star(cur))
        small.write.parquet(new)
        delete_path(spark, path)
        path, cur = new, spark.read.schema(small.schema).parquet(new)
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _is_stars(e: DataFrame) -> bool:
    """Whether each node has one edge to a smaller one at most, and then none from it: each star is a component."""
    ends = e.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0").isEmpty()


def _large_star(e: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the smallest of the node and its neighbours."""
    both = e.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(e.select(F.col("v").alias("n"), F.col("u").alias("m")))
    least = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("lo"))
    return both.where("m > n").join(least, "n").select(F.col("m").alias("u"), F.col("lo").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Link each smaller neighbour of a node, and the node, to the smallest of them. Here u > v in every edge."""
    least = e.groupBy("u").agg(F.min("v").alias("lo"))
    moved = e.join(least, "u").where("v <> lo").select(F.col("v").alias("u"), F.col("lo").alias("v"))
    return moved.unionByName(least.select("u", F.col("lo").alias("v"))).distinct()
