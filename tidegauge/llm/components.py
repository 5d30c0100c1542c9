"""Connected components of an edge table by alternating minimum-label steps; every step is a join and a pre-aggregated group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.session import stored


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): the label is the smallest node that can be reached.

    Large-star and small-star steps (Kiveris and others, 2014): each links neighbours to the smallest one seen, so a chain
    halves in every round and a hub's links are dealt by the many small sides. Ends when every node is linked to its label.
    """
    links = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    for _ in range(most_rounds):
        if _settled(links):
            break
        links = stored(_small_star(_large_star(links)), "links")
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)


def _settled(links: DataFrame) -> bool:
    """Whether each node has one smaller neighbour at most, and none if it has a larger one."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
        links.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    sides = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return sides.agg(F.max(F.col("down") + F.col("up"))).first()[0] in (None, 1)


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to its smallest neighbour (itself included)."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    others = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
