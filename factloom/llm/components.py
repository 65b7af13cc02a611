"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import drop, materialize


def _least(edges: DataFrame) -> DataFrame:
    """The smallest of each node and its neighbours; edges go both ways."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b); root is the smallest node of its component.

    Each round hangs every larger neighbour of a node on the node's smallest neighbour, then every node and its smaller
    neighbours on the smallest of them; components become stars after a logarithmic number of rounds, and rounds go on until
    they are. A hub with very many neighbours meets its minimum by a partial aggregate that is written, and a plain join with
    it, which can be split. Links and roots stay distributed.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = materialize(edges, "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(_least(both), "least")
        # Every edge has its larger node as u: with the nodes turned round, v is the larger neighbour.
        large = edges.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialize(large, "large")
        down = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = down.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        small = materialize(small, "stars")
        drop(edges, least, large)
        edges = small
        # Done when every node has one edge and no root hangs on another.
        roots = small.select(F.col("v").alias("u")).distinct()
        crossing = small.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").select("u").unionByName(small.join(roots, "u", "left_semi").select("u"))
        if crossing.isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
