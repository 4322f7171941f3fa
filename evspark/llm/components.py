"""Connected components of an undirected graph, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evspark.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    told = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return told.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether each node has one edge to a smaller one at most, and none where a greater one has an edge to it."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1 AND up > 0").isEmpty()


def components(links: DataFrame, a: str, b: str, steps: int = 60, found: DataFrame | None = None) -> DataFrame | None:
    """node, component (its smallest node) of every node that has a link to another; None if there is no link. `found` is such
    a table for other links, which count too."""
    links = links.select(a, b) if found is None else links.select(a, b).unionByName(found.toDF(a, b))
    edges = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    for step in range(steps):
        edges = written(edges, "stars")
        if not step and edges.isEmpty():
            return None
        if _stars(edges):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        edges = _small_star(_large_star(edges))
    raise RuntimeError(f"components didn't settle in {steps} steps")
