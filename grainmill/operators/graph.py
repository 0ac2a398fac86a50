"""Connected components of a table of links: the nodes of a star contraction in a few rounds, whatever the longest path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.plans.tables import discard, materialize


def _star(edges: DataFrame, all_neighbours: bool) -> DataFrame:
    """Links of the neighbours of each node (only the larger ones, or the smaller ones and itself) to the least of its neighbourhood."""
    if all_neighbours:
        sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sides.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        out = sides.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one link to a node that has none: then the components are stars around their least nodes."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    each = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
    return not each.agg(F.max((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("in") > 0)))).first()[0]


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of links (u, v); component: the least node within reach.

    Rounds grow with the logarithm of the longest path; each is a table of its own and the one before it is deleted. They end
    when the links are stars, which one aggregation tells, so no round is spent on finding that nothing changes.
    """
    edges = materialize(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links", cleanup=False)
    for _ in range(most_rounds):
        if _settled(edges):
            least = edges.select("v").distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(least.select(F.col("v").alias("node"), F.col("v").alias("component")))
        spent, edges = edges, materialize(_star(_star(edges, True), False), "links", cleanup=False)
        discard(spent)
    raise RuntimeError("components did not settle")
