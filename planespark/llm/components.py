"""Connected components of a link table: large-star and small-star rounds, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planespark.llm.common import Workspace


def components(links: DataFrame, work: Workspace, name: str = "star") -> DataFrame:
    """(id, component) for every id that occurs in ``links`` (a, b): the smallest id that can be reached.

    Loops and repeated links are ignored; an empty table gives an empty result.
    Minima are taken with partial aggregation and joined back, so an id with
    very many links is split by the skew join and never gathered in one task.
    The rounds end when the links are stars, which is tested exactly.
    """
    edges = work.save(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}0")
    k = 0
    while not _settled(edges):
        k += 1
        edges = work.save(_small_star(_large_star(edges)), f"{name}{k}")
        work.drop(f"{name}{k - 1}")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def _settled(edges: DataFrame) -> bool:
    """Whether all edges form stars around smallest ids: every node is either a centre or has one edge, to its centre."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least).distinct()
