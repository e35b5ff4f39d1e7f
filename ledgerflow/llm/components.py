"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.tables import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    rest = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.withColumnRenamed("m", "v")).distinct()


def extended(found: DataFrame, edges: DataFrame) -> DataFrame:
    """The components (node, component) after more edges (u, v).

    What is one component already counts as one node, so only what the new edges bring
    together is worked on.
    """
    for end in ("u", "v"):
        known = found.select(F.col("node").alias(end), F.col("component").alias("c"))
        edges = edges.join(known, end, "left").withColumn(f"{end}_of", F.coalesce("c", end)).drop("c")
    edges = stored(edges, "new-edges")
    joined = components(edges.select(F.col("u_of").alias("u"), F.col("v_of").alias("v"))).select(F.col("node").alias("component"), F.col("component").alias("into"))
    nodes = edges.select(F.col("u").alias("node"), F.col("u_of").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v_of").alias("component")))
    return found.unionByName(nodes).distinct().join(joined, "component", "left").select("node", F.coalesce("into", "component").alias("component"))


def _only_stars(edges: DataFrame) -> bool:
    """Whether every larger node has one edge and every smaller one is its star's centre; more
    rounds would change nothing then."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    return ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).filter("ups > 1 or ups = 1 and least = 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (u, v): the smallest node it reaches.

    Both steps aggregate before they join, so a node with a third of all edges is spread over
    many tasks; every round is written to the shared folder. No edges give no rows.
    """
    now = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _only_stars(now):
        now = stored(_small_star(_large_star(now)), "edges")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
