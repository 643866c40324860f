"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """`links` (u long, v long) -> (node long, root long): nodes with the same root are connected.

    Randomised contraction: each round every node points to the neighbour (or itself) of least hashed priority, the
    graph is redrawn between the pointed-at nodes, and parallel links fall together. The priority changes each round,
    so that chains shrink by a constant factor whatever their numbering. No node's neighbours are ever gathered: the
    minimum is pre-aggregated, and the redrawing is two joins that Spark may split where they are skewed.
    Links with a null end are ignored; an empty table gives an empty result.
    """
    links = cut(links.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    rounds = []
    while not links.isEmpty():
        seed = F.lit(len(rounds))
        both = links.union(links.select("v", "u")).select("u", F.col("v"))
        rank = lambda c: F.struct(F.xxhash64(seed, c).alias("rank"), F.col(c).alias("node"))
        points = both.groupBy("u").agg(F.min(rank("v")).alias("near"))
        points = cut(points.select("u", F.least("near", rank("u"))["node"].alias("to")))
        rounds.append(points)
        at_u = links.join(points, "u").select(F.col("to").alias("a"), "v")
        drawn = at_u.join(points.select(F.col("u").alias("v"), F.col("to").alias("b")), "v").where("a != b")
        links = cut(drawn.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    if not rounds:
        return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = rounds[-1].select(F.col("u").alias("node"), F.col("to").alias("root"))
    for points in reversed(rounds[:-1]):
        later = roots.select(F.col("node").alias("to"), "root")
        roots = points.join(later, "to", "left").select(F.col("u").alias("node"), F.coalesce("root", "to").alias("root"))
    return roots
