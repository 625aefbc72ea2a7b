"""Connected components by alternating large-star and small-star steps, each a join and an aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links (a long, b long): root is the smallest node of its component.

    Links may repeat and go either way; loops are ignored; no links give no rows. Every step pre-aggregates minima before the
    shuffle, and the join of a hub's links with its one minimum is one that Spark can split. Each round's links are written to
    the shared folder, so a lost executor costs that round at most.
    """
    a, b = F.col("a"), F.col("b")
    edges = materialize(links.where(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "links")
    before = None
    while True:
        total = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")).first()
        if tuple(total) == before or total.n == 0:
            break
        before = tuple(total)
        made = materialize(small_star(large_star(edges)), "links")
        discard(edges)
        edges = made
    roots = edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(roots)


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest one, or to the node itself."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return both.join(least, F.col("u") == F.col("k")).where(F.col("v") > F.col("u")).select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to the smallest one."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("k"), "m")
    moved = edges.join(least, F.col("hi") == F.col("k")).where(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(least.select(F.col("k").alias("hi"), F.col("m").alias("lo"))).distinct()
