"""Connected components of a link table, by alternating large and small stars.

Each round replaces links by links to smaller nodes: a large star ties the greater neighbours of a node to its least neighbour, a
small star the lesser ones. When nothing changes, every node hangs on the least node of its component. Rounds
are stored; nothing but one count and checksum per round reaches the driver. A node of many links is a frequent join key,
which Spark splits, and minima are combined before their shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _large(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(links: DataFrame) -> DataFrame:
    """``links`` point from the greater node u to the lesser v."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node with a link; ``links`` has long columns a and b. Loops and repeated links do no harm."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, last = materialize(edges, "links"), None
    for _ in range(most_rounds):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == last:
            return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        last = state
        edges = materialize(_small(_large(edges)), "links")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
