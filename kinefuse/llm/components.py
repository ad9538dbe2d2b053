"""Connected components of a table of links, by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinefuse.storage import write_and_read

MOST_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """node, comp (least node reachable) of every node that a link (a, b) of longs names.

    Each round replaces links by as many or fewer, grouped by partial minima, so a node with very many
    links is not gathered anywhere. Rounds end when the links no longer change; their number grows
    with the logarithm of the longest chain.
    """
    edges = write_and_read(links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct(), "links")
    state = None
    for _ in range(MOST_ROUNDS):
        found = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        if found == state:
            return edges.select(F.col("v").alias("node"), F.col("m").alias("comp")).union(edges.select("m", "m").distinct())
        state = found
        edges = write_and_read(_small_star(_large_star(edges)), "links")
    raise RuntimeError("links did not settle")


def _large_star(edges: DataFrame) -> DataFrame:
    """Links the larger neighbours of each node to its least one."""
    both = edges.select(F.col("v").alias("u"), F.col("m").alias("w")).union(edges.select("m", "v"))
    least = both.groupBy("u").agg(F.least(F.min("w"), F.col("u")).alias("m"))
    return both.where("w > u").join(least, "u").select(F.col("w").alias("v"), "m").where("v <> m").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the least of them."""
    least = edges.groupBy("v").agg(F.min("m").alias("m"))
    moved = edges.withColumnRenamed("m", "w").join(least, "v").select(F.col("w").alias("v"), "m")
    return moved.union(least).where("v <> m").distinct()
