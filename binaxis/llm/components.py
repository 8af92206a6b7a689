"""Connected components of a link table, on the executors alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_groups


def _smallest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return join_groups(both, _smallest(both), "u", "n", 2 * n).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _smallest(down)
    moved = join_groups(down, least, "u", "n", n).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _said(edges: DataFrame) -> tuple[int, object]:
    """(number of links, a sum that tells tables of links apart)."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(u, root): each linked node with the smallest node that it can reach.

    ``links`` has two columns of nodes. Large-star and small-star steps in turn make every
    component a star about its smallest node; each round is written to the shared folder. A node with a large share of all links
    tells its least neighbour by a bounded broadcast, so its links never meet in one task. Links
    of a node to itself, or with a null, say nothing; a node in no other link is not returned.
    """
    a, b = links.columns
    edges = cut(links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct(), "links")
    said = _said(edges)
    while said[0]:
        edges = cut(_large_star(edges, said[0]), "links")
        edges = cut(_small_star(edges, edges.count()), "links")
        now = _said(edges)
        if now == said:
            break
        said = now
    return edges.select("u", F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
