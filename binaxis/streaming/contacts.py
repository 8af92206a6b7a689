"""Contacts from a stream: counts per pair of bins are additive, so they update as events arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import KEY


def running_contacts(pairs: DataFrame) -> DataFrame:
    """Counts of a stream of (chrom, resolution, bin_i, bin_j); write in update mode."""
    lo, hi = F.least("bin_i", "bin_j"), F.greatest("bin_i", "bin_j")
    return pairs.groupBy(*KEY, lo.alias("bin_i"), hi.alias("bin_j")).agg(F.count(F.lit(1)).cast("double").alias("count"))


def windowed_contacts(pairs: DataFrame, late: str = "1 hour", every: str = "1 hour") -> DataFrame:
    """The same per window of the event time ``ts``; a window closes, and can be appended, once events are ``late``."""
    lo, hi = F.least("bin_i", "bin_j"), F.greatest("bin_i", "bin_j")
    grouped = pairs.withWatermark("ts", late).groupBy(F.window("ts", every), *KEY, lo.alias("bin_i"), hi.alias("bin_j"))
    return grouped.agg(F.count(F.lit(1)).cast("double").alias("count")).select(F.col("window.start").alias("from"), *KEY, "bin_i", "bin_j", "count")
