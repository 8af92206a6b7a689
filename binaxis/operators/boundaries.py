"""Boundaries of domains, their clusters, and consensus boundaries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import consensus_color, snap
from ..schema import KEY


def boundaries(domains: DataFrame, *keys: str) -> DataFrame:
    """Distinct starts and ends as ``pos``, by the given keys."""
    keys = keys or ("algorithm", *KEY)
    return domains.select(*keys, F.explode(F.array("start", "end")).alias("pos")).distinct()


def snapped(domains: DataFrame, *keys: str) -> DataFrame:
    """Boundaries moved to the nearest bin edge of their resolution."""
    keys = keys or ("algorithm", *KEY)
    return boundaries(domains, *keys).withColumn("pos", snap(F.col("pos"), F.col("resolution"))).distinct()


def running_median_clusters(positions: list[int], tolerance: float) -> list[int]:
    """Cluster number of each sorted position: one joins while it is within ``tolerance`` of the median of the cluster so far."""
    out, members, number = [], [], -1
    for p in positions:
        k = len(members)
        centre = (members[(k - 1) // 2] + members[k // 2]) / 2 if k else None
        if k and abs(p - centre) <= tolerance:
            members.append(p)
        else:
            members, number = [p], number + 1
        out.append(number)
    return out


def clusters(positions: DataFrame, tolerance_bins: int = 1, on_grid: bool = True) -> DataFrame:
    """(chrom, resolution, pos, cluster) of distinct positions.

    With a tolerance of one bin, positions on the grid cluster in closed form: runs of consecutive bins, in pairs. A larger
    tolerance needs the running median, one chromosome at a time.
    """
    if tolerance_bins == 1 and on_grid:
        order = Window.partitionBy(*KEY).orderBy("pos")
        island = F.col("pos") - F.col("resolution") * F.row_number().over(order)
        within = Window.partitionBy(*KEY, "_island").orderBy("pos")
        first = F.first("pos").over(within)
        pair = F.floor((F.row_number().over(within) - 1) / 2)
        return positions.withColumn("_island", island).select(*KEY, "pos", (first + 2 * pair * F.col("resolution")).alias("cluster"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        return pdf.assign(cluster=running_median_clusters(pdf["pos"].tolist(), tolerance_bins * int(pdf["resolution"].iloc[0])) if len(pdf) else [])

    return positions.select(*KEY, "pos").groupBy(*KEY).applyInPandas(walk, "chrom string, resolution int, pos long, cluster long")


def consensus(domains: DataFrame, tolerance_bins: int = 1, min_support: int = 2, saturate: bool = False, least_algorithms: int = 0) -> DataFrame:
    """(chrom, resolution, position, support, color): clusters of boundaries of all algorithms.

    A cluster's position is the whole part of its median, its support the number of algorithms with a boundary in it.
    ``least_algorithms``: keys with fewer algorithms give nothing.
    """
    own = snapped(domains)
    if least_algorithms > 1:
        enough = own.groupBy(*KEY).agg(F.countDistinct("algorithm").alias("_n")).filter(F.col("_n") >= least_algorithms)
        own = own.join(enough.select(*KEY), KEY, "left_semi")
    found = clusters(own.select(*KEY, "pos").distinct(), tolerance_bins)
    centre = found.groupBy(*KEY, "cluster").agg(F.median("pos").cast("long").alias("position"))
    support = own.join(found, [*KEY, "pos"]).groupBy(*KEY, "cluster").agg(F.countDistinct("algorithm").cast("int").alias("support"))
    out = centre.join(support, [*KEY, "cluster"]).filter(F.col("support") >= min_support)
    return out.select(*KEY, "position", "support", consensus_color(F.col("support"), saturate).alias("color"))


def consensus_bed6(found: DataFrame) -> DataFrame:
    name = F.concat(F.lit("consensus_support"), F.col("support"))
    return found.select("chrom", F.col("position").alias("start"), (F.col("position") + F.col("resolution")).alias("end"), name.alias("name"), F.col("support").alias("score"), F.lit(".").alias("strand"))


def bin_support(domains: DataFrame, min_support: int = 2) -> DataFrame:
    """(chrom, resolution, bin, support): bins inside domains of at least so many algorithms."""
    last = F.floor((F.col("end") - 1) / F.col("resolution"))
    bins = domains.filter("end > start").select("algorithm", *KEY, F.explode(F.sequence(F.floor(F.col("start") / F.col("resolution")), last)).alias("bin"))
    return bins.groupBy(*KEY, "bin").agg(F.countDistinct("algorithm").cast("int").alias("support")).filter(F.col("support") >= min_support)
