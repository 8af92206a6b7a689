"""Range joins by buckets: an equi-join on (keys, bucket) with the exact condition besides.

Buckets as wide as the reach of the condition keep every match within neighbouring buckets, so no key is joined
with all rows of its chromosome.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def near(left: DataFrame, right: DataFrame, keys: list[str], bins: int = 1, how: str = "left_semi", pos: str = "pos") -> DataFrame:
    """Rows of ``left`` with a row of ``right`` at most ``bins`` bins away (``left_anti``: without). Both have ``resolution``."""
    width = F.greatest(F.col("resolution") * F.lit(bins), F.lit(1))
    at = F.floor(F.col(pos) / width)
    a = left.withColumn("_bucket", at)
    b = right.select(*keys, F.col(pos).alias("_pos"), F.explode(F.sequence(at - 1, at + 1)).alias("_bucket")).distinct()
    match = [a[k] == b[k] for k in keys] + [a["_bucket"] == b["_bucket"], F.abs(a[pos] - b["_pos"]) <= a["resolution"] * bins]
    cond = match[0]
    for m in match[1:]:
        cond = cond & m
    return a.join(b, cond, how).drop("_bucket")


def overlaps(windows: DataFrame, peaks: DataFrame, width: int, keys: list[str]) -> DataFrame:
    """Pairs (window keys, peak_id), each once, of overlapping half-open intervals on a chromosome.

    ``width`` is the bucket: about the longest window.
    """
    buckets = lambda: F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.greatest(F.col("end"), F.col("start") + 1) - 1) / width)))
    named = {k: f"_k{i}" for i, k in enumerate(keys)}
    w = windows.filter("end > start").select(*(F.col(k).alias(n) for k, n in named.items()), F.col("chrom").alias("_chrom"), F.col("start").alias("_s"), F.col("end").alias("_e"), buckets().alias("_bucket"))
    p = peaks.select("peak_id", F.col("chrom").alias("_chrom"), F.col("start").alias("_ps"), F.col("end").alias("_pe"), buckets().alias("_bucket"))
    pairs = w.join(p, ["_chrom", "_bucket"]).filter("_ps < _e and _pe > _s")
    return pairs.select(*(F.col(n).alias(k) for k, n in named.items()), "peak_id").distinct()
