"""Enrichment of interval tracks at boundaries: overlaps, permutations, distance profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import midpoint, upper_tail
from ..schema import KEY
from .boundaries import boundaries
from .range_join import overlaps

ALGO = ["algorithm", *KEY]


def windows(domains: DataFrame, window_bins: int = 1, keys: list[str] | None = None) -> DataFrame:
    """Around each boundary, so many bins to both sides, from 0 on."""
    half = F.lit(window_bins) * F.col("resolution")
    return boundaries(domains, *(keys or ALGO)).select(*(keys or ALGO), F.greatest(F.col("pos") - half, F.lit(0)).alias("start"), (F.col("pos") + half).alias("end"))


def observed(domains: DataFrame, peaks: DataFrame, width: int, window_bins: int = 1, keys: list[str] | None = None) -> DataFrame:
    """(keys, observed_count): peaks that overlap any window."""
    keys = keys or ALGO
    hit = overlaps(windows(domains, window_bins, keys), peaks, width, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("observed_count"))
    return domains.select(*keys).distinct().join(hit, keys, "left").fillna({"observed_count": 0})


def random_starts(n: DataFrame, permutations: int, seed: int = 42, exact: bool = False) -> DataFrame:
    """(keys, perm, length, starts): for each permutation the starts of as many windows as ``n`` tells, of ``length``, at random within ``size``.

    ``n`` has (keys, n, length, size). The generator is integer arithmetic that any SQL engine repeats; ``exact`` draws with
    NumPy's default generator instead, seeded with seed + permutation. Without room or windows there are no starts.
    """
    keys = [c for c in n.columns if c not in ("n", "length", "size")]
    each = n.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    # few small rows, each of which draws many windows: dealt to as many tasks as a shuffle has, which adaptive plans would merge
    each = each.repartition(int(n.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "perm")
    room = each.filter("n > 0 and size > length")
    if exact:
        def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                for lo in range(0, len(pdf), 1000):
                    part = pdf.iloc[lo : lo + 1000]
                    starts = [np.random.default_rng(seed + r.perm).integers(0, r.size - r.length, size=r.n) for r in part[["perm", "size", "length", "n"]].itertuples(index=False)]
                    yield part[[*keys, "perm", "length"]].assign(starts=starts)

        kinds = dict(n.dtypes)
        return room.mapInPandas(draw, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "perm int, length long, starts array<long>"]))

    def start(k):
        x = ((F.col("perm") + seed) * F.lit(1103515245).cast("long") + k * 214013 + 2531011) % F.lit(1 << 31)
        y = (x * 1664525 + 1013904223) % F.lit(1 << 32)
        return F.shiftright(y * (F.col("size") - F.col("length")), 32)

    return room.select(*keys, "perm", F.col("length").cast("long").alias("length"), F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), start).alias("starts"))


def random_windows(n: DataFrame, permutations: int, seed: int = 42, exact: bool = False) -> DataFrame:
    """(keys, perm, start, end): the same, a row for each window."""
    drawn = random_starts(n, permutations, seed, exact)
    return drawn.withColumn("start", F.explode("starts")).withColumn("end", F.col("start") + F.col("length")).drop("starts", "length")


def peak_index(peaks: DataFrame, width: int) -> DataFrame:
    """(chrom, last, reach, bucket, starts, ends, before_s, before_e, near): where peaks start and end, by buckets of the axis.

    ``starts`` and ``ends`` lie in the bucket, ``before_s`` and ``before_e`` count those in buckets before; ``near`` holds the peaks that begin in
    this bucket or reach into it. ``reach`` is the longest peak, ``last`` the last bucket. Every bucket up to the last is there, so counts of any place need one equi-join.
    """
    own = peaks.select("chrom", F.col("start").cast("long").alias("start"), F.greatest("end", "start").cast("long").alias("end"))
    at = lambda c: F.floor(F.col(c) / width)
    whole = own.groupBy("chrom").agg(F.max(at("end")).alias("last"), F.max(F.col("end") - F.col("start")).alias("reach"))
    s = own.groupBy("chrom", at("start").alias("bucket")).agg(F.collect_list("start").alias("starts"))
    e = own.groupBy("chrom", at("end").alias("bucket")).agg(F.collect_list("end").alias("ends"))
    n = own.select("chrom", F.explode(F.sequence(at("start"), at("end"))).alias("bucket"), F.struct("start", "end").alias("p")).groupBy("chrom", "bucket").agg(F.collect_list("p").alias("near"))
    every = whole.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    out = every.join(s, ["chrom", "bucket"], "left").join(e, ["chrom", "bucket"], "left").join(n, ["chrom", "bucket"], "left")
    before = Window.partitionBy("chrom").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return out.withColumns({"before_s": F.coalesce(F.sum(size("starts")).over(before), F.lit(0)), "before_e": F.coalesce(F.sum(size("ends")).over(before), F.lit(0))})


def hit_counts(drawn: DataFrame, peaks: DataFrame, width: int, keys: list[str]) -> DataFrame:
    """(keys, n): peaks that overlap any of the windows of a row of ``drawn``, which has (keys, starts, length) and ``chrom`` among the keys.

    A row's windows are of one length, so between sorted ones lie its gaps, and a peak is not overlapped only if it lies in a gap. Peaks inside a gap [a, b]
    are those that end by b, less those that start before a, but for those that do both sides at once, start before a and end after b. So each gap asks
    the index of peaks at two places, and neither pairs of windows and peaks nor a distinct are made.
    """
    index = peak_index(peaks, width)
    starts = F.sort_array("starts")
    ends_of = lambda a: F.concat(F.array(F.lit(None).cast("long")), F.transform(a, lambda x: x + F.col("length")))
    gaps = F.arrays_zip(ends_of(starts).alias("a"), F.concat(starts, F.array(F.lit(None).cast("long"))).alias("b"))
    each = drawn.select(*keys, F.explode(gaps).alias("g")).select(*keys, F.col("g")["a"].alias("a"), F.col("g")["b"].alias("b")).filter("a is null or b is null or b >= a")
    asked = each.select(*keys, "a", "b", F.explode(F.array(F.lit(True), F.lit(False))).alias("at_a")).withColumn("x", F.when(F.col("at_a"), F.col("a")).otherwise(F.col("b"))).filter("x is not null")
    tops = index.select("chrom", "last", "reach").distinct()
    asked = asked.join(F.broadcast(tops), "chrom").withColumn("bucket", F.greatest(F.lit(0).cast("long"), F.least(F.floor(F.col("x") / width), F.col("last"))))  # a row a chromosome
    met = asked.join(index.drop("last", "reach"), ["chrom", "bucket"])
    under = lambda c, test: F.coalesce(F.size(F.filter(c, test)), F.lit(0))
    both = F.when(F.col("b") - F.col("a") < F.col("reach"), under("near", lambda p: (p["start"] < F.col("a")) & (p["end"] > F.col("b")))).otherwise(0)
    started = F.col("before_s") + under("starts", lambda p: p < F.col("x"))
    ended = F.col("before_e") + under("ends", lambda p: p <= F.col("x"))
    # the gap before the first window holds what ends by it, that after the last what does not start before it; so the number of all peaks drops out
    return met.groupBy(*keys).agg(F.sum(F.when(F.col("at_a"), started - both).otherwise(-ended)).cast("long").alias("n"))


def null_counts(domains: DataFrame, peaks: DataFrame, sizes: DataFrame, width: int, permutations: int, window_bins: int = 1, seed: int = 42, exact: bool = False, keys: list[str] | None = None) -> DataFrame:
    """(keys, perm, n): peaks overlapped by the random windows of each permutation; permutations are rows of one plan."""
    keys = keys or ALGO
    n = boundaries(domains, *keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("length", 2 * F.lit(window_bins).cast("long") * F.col("resolution")).join(sizes.select("chrom", "size"), "chrom")
    hit = hit_counts(random_starts(n, permutations, seed, exact), peaks, width, [*keys, "perm"])
    every = n.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("perm"))
    return every.join(hit, [*keys, "perm"], "left").fillna({"n": 0})


def enrichment(domains: DataFrame, peaks: DataFrame, sizes: DataFrame, width: int, permutations: int = 1000, window_bins: int = 1, seed: int = 42, exact: bool = False, keys: list[str] | None = None) -> DataFrame:
    """Observed count against mean and deviation of the permutations: ratio, z and one-sided p."""
    keys = keys or ALGO
    null = null_counts(domains, peaks, sizes, width, permutations, window_bins, seed, exact, keys).groupBy(*keys).agg(F.avg("n").alias("mean_random"), F.stddev_pop("n").alias("std_random"))
    out = observed(domains, peaks, width, window_bins, keys).join(null, keys, "left")
    out = out.withColumn("enrichment_score", F.col("observed_count") / (F.col("mean_random") + 1e-9)).withColumn("z_score", (F.col("observed_count") - F.col("mean_random")) / (F.col("std_random") + 1e-9))
    return out.withColumn("p_value", upper_tail(F.col("z_score")))


def consensus_enrichment(consensus: DataFrame, peaks: DataFrame, sizes: DataFrame, width: int, permutations: int = 1000, supports: tuple[int, ...] = (2, 3, 4), **more) -> DataFrame:
    """The same for consensus boundaries of each support, as domains one bin long: both ends of them count."""
    own = consensus.filter(F.col("support").isin(*supports)).select("support", *KEY, F.col("position").alias("start"), (F.col("position") + F.col("resolution")).alias("end"))
    return enrichment(own, peaks, sizes, width, permutations, keys=["support", *KEY], **more)


def validation(domains: DataFrame, consensus: DataFrame, peaks: DataFrame, sizes: DataFrame, width: int, permutations: int = 1000, **more) -> DataFrame:
    """Rows of algorithms and of consensus supports, one under the other."""
    a = enrichment(domains, peaks, sizes, width, permutations, **more).withColumn("type", F.lit("algorithm"))
    b = consensus_enrichment(consensus, peaks, sizes, width, permutations, **more).withColumn("type", F.lit("consensus"))
    return a.unionByName(b, allowMissingColumns=True)


def profile(domains: DataFrame, peaks: DataFrame, sizes: DataFrame, reach: int = 500_000, step: int = 10_000) -> DataFrame:
    """(keys, bin, center, n, density): peak midpoints by distance from boundaries, per boundary and kb.

    Boundaries nearer than ``reach`` to an end of the chromosome count in the divisor alone.
    """
    own = boundaries(domains)
    total = own.groupBy(*ALGO).agg(F.count(F.lit(1)).alias("_all"))
    inner = own.join(sizes.select("chrom", "size"), "chrom").filter((F.col("pos") >= reach) & (F.col("pos") <= F.col("size") - reach))
    bucket = F.floor(F.col("pos") / reach)
    left = inner.select(*ALGO, "pos", F.explode(F.sequence(bucket - 1, bucket + 1)).alias("_bucket"))
    mids = peaks.select("chrom", midpoint(F.col("start"), F.col("end")).alias("mid")).withColumn("_bucket", F.floor(F.col("mid") / reach))
    offs = left.join(mids, ["chrom", "_bucket"]).withColumn("off", F.col("mid") - F.col("pos")).filter((F.col("off") >= -reach) & (F.col("off") < reach))
    counts = offs.groupBy(*ALGO, F.floor((F.col("off") + reach) / step).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = total.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(2 * reach // step - 1))))
    out = every.join(counts, [*ALGO, "bin"], "left").fillna({"n": 0})
    return out.select(*ALGO, "bin", (F.col("bin") * step - reach + step / 2).alias("center"), "n", (F.col("n") / (F.col("_all") * (step / 1000.0))).alias("density"))
