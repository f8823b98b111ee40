"""Connected components of a graph given as an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import forget, saved


def _settled(e: DataFrame) -> bool:
    """Whether every node is either a child with one parent or a parent."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
    odd = ends.groupBy("x").agg(F.sum("child").alias("child"), F.max("parent").alias("parent")).filter("child + parent > 1")
    return not odd.agg(F.count(F.lit(1))).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of edges (u, v): comp is the smallest node that links reach.

    Edges are kept from the larger to the smaller node. A step moves each edge's smaller end to that node's least
    neighbour (large-star), then links the smaller neighbours of each node to the least of them (small-star). The number
    of edges never grows and the number of steps grows with the logarithm of the longest chain. Every step's table is
    written to the shared folder. Loops and repeated edges are allowed; without edges there are no nodes.
    """
    e = saved(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _settled(e):
        up = e.groupBy("u").agg(F.min("v").alias("m"))
        large = e.join(up.select(F.col("u").alias("v"), "m"), "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        n = saved(small, "edges")
        forget(e)
        e = n
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
