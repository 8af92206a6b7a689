"""Comparison of algorithms with each other, with consensus boundaries and with a reference list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import KEY
from .boundaries import boundaries
from .range_join import near

ALGO = ["algorithm", *KEY]


def spine(domains: DataFrame, algorithms: DataFrame | None = None) -> DataFrame:
    """Every algorithm with every (chrom, resolution): keys without a result keep their row. Both sides are small dimensions."""
    algorithms = domains.select("algorithm").distinct() if algorithms is None else algorithms
    return algorithms.join(domains.select(*KEY).distinct(), F.lit(True))


def consensus_hits(domains: DataFrame, consensus: DataFrame, min_support: int = 2) -> DataFrame:
    """(algorithm, chrom, resolution, n_bnd, n_hit, pct): boundaries within a bin of a consensus boundary."""
    own = boundaries(domains)
    right = consensus.filter(F.col("support") >= min_support).select(*KEY, F.col("position").alias("pos"))
    hit = near(own, right, KEY).groupBy(*ALGO).agg(F.count(F.lit(1)).alias("n_hit"))
    return own.groupBy(*ALGO).agg(F.count(F.lit(1)).alias("n_bnd")).join(hit, ALGO, "left").select(*ALGO, "n_bnd", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), (100.0 * F.coalesce("n_hit", F.lit(0)) / F.col("n_bnd")).alias("pct"))


def basic_stats(domains: DataFrame, sizes: DataFrame, consensus: DataFrame | None = None, keys: DataFrame | None = None) -> DataFrame:
    """Counts, sizes in kb, coverage of the chromosome and share of consensus boundaries, for every key of ``keys``."""
    kb = (F.col("end") - F.col("start")) / 1000.0
    stats = domains.groupBy(*ALGO).agg(F.count(F.lit(1)).alias("n_tads"), F.median(kb).alias("median_size_kb"), F.avg(kb).alias("mean_size_kb"), F.stddev_pop(kb).alias("std_size_kb"), F.sum(F.col("end") - F.col("start")).alias("_covered"))
    out = (spine(domains) if keys is None else keys).join(stats, ALGO, "left").join(sizes.select("chrom", "size"), "chrom", "left")
    covered = F.when(F.col("size") > 0, 100.0 * F.coalesce("_covered", F.lit(0)) / F.col("size")).otherwise(0.0)
    out = out.withColumn("n_tads", F.coalesce("n_tads", F.lit(0))).withColumn("coverage_pct", covered).drop("_covered", "size")
    if consensus is None:
        return out.withColumn("n_consensus_bnd", F.lit(0).cast("long")).withColumn("pct_consensus_bnd", F.lit(0.0))
    hits = consensus_hits(domains, consensus).select(*ALGO, F.col("n_hit").alias("n_consensus_bnd"), F.col("pct").alias("pct_consensus_bnd"))
    return out.join(hits, ALGO, "left").fillna({"n_consensus_bnd": 0, "pct_consensus_bnd": 0.0})


def _pairs(keys: DataFrame, ordered: bool) -> DataFrame:
    a, b = keys.withColumnRenamed("algorithm", "algo_a"), keys.withColumnRenamed("algorithm", "algo_b")
    return a.join(b, KEY).filter("algo_a <> algo_b" if ordered else "algo_a < algo_b")


def pairwise_jaccard(domains: DataFrame, ordered: bool = False, both_empty: float = 1.0, keys: DataFrame | None = None) -> DataFrame:
    """(algo_a, algo_b, chrom, resolution, jaccard) of the sets of (start, end); ``both_empty`` where neither has a domain."""
    own = domains.select(*ALGO, "start", "end").distinct()
    n = own.groupBy(*ALGO).agg(F.count(F.lit(1)).alias("n"))
    a, b = own.withColumnRenamed("algorithm", "algo_a"), own.withColumnRenamed("algorithm", "algo_b")
    shared = a.join(b, [*KEY, "start", "end"]).groupBy("algo_a", "algo_b", *KEY).agg(F.count(F.lit(1)).alias("shared"))
    out = _pairs(spine(domains) if keys is None else keys, ordered).join(shared, ["algo_a", "algo_b", *KEY], "left")
    for side in ("a", "b"):
        out = out.join(n.select(F.col("algorithm").alias(f"algo_{side}"), *KEY, F.col("n").alias(f"n_{side}")), [f"algo_{side}", *KEY], "left")
    out = out.fillna({"shared": 0, "n_a": 0, "n_b": 0})
    union = F.col("n_a") + F.col("n_b") - F.col("shared")
    return out.select("algo_a", "algo_b", *KEY, F.when(union > 0, F.col("shared") / union).otherwise(F.lit(both_empty)).alias("jaccard"))


def overlap_rates(domains: DataFrame, tolerance_bins: int = 1, keys: DataFrame | None = None) -> DataFrame:
    """(algo_a, algo_b, chrom, resolution, rate), in both directions: percent of a's boundaries near one of b; null where a has none."""
    own = boundaries(domains)
    n = own.groupBy(F.col("algorithm").alias("algo_a"), *KEY).agg(F.count(F.lit(1)).alias("n"))
    pairs = _pairs(spine(domains) if keys is None else keys, True)
    left = pairs.join(own.withColumnRenamed("algorithm", "algo_a"), ["algo_a", *KEY])
    hit = near(left, own.withColumnRenamed("algorithm", "algo_b"), ["algo_b", *KEY], tolerance_bins).groupBy("algo_a", "algo_b", *KEY).agg(F.count(F.lit(1)).alias("hit"))
    out = pairs.join(n, ["algo_a", *KEY], "left").join(hit, ["algo_a", "algo_b", *KEY], "left")
    return out.select("algo_a", "algo_b", *KEY, F.when(F.col("n") > 0, 100.0 * F.coalesce("hit", F.lit(0)) / F.col("n")).alias("rate"))


def pairwise_overlap(domains: DataFrame, tolerance_bins: int = 1, keys: DataFrame | None = None) -> DataFrame:
    """One row for each pair of algorithms with both rates."""
    r = overlap_rates(domains, tolerance_bins, keys)
    back = r.select(F.col("algo_b").alias("algo_a"), F.col("algo_a").alias("algo_b"), *KEY, F.col("rate").alias("overlap_b_in_a"))
    return r.filter("algo_a < algo_b").withColumnRenamed("rate", "overlap_a_in_b").join(back, ["algo_a", "algo_b", *KEY])


def pairwise_matrix(domains: DataFrame, measure: str = "jaccard", tolerance_bins: int = 1) -> DataFrame:
    """A row and a column for each algorithm; 1 (or 100) on the diagonal."""
    names = sorted(r["algorithm"] for r in domains.select("algorithm").distinct().collect())  # the callers' names
    cells = pairwise_jaccard(domains, ordered=True).withColumnRenamed("jaccard", "value") if measure == "jaccard" else overlap_rates(domains, tolerance_bins).withColumnRenamed("rate", "value")
    same = spine(domains).select(F.col("algorithm").alias("algo_a"), F.col("algorithm").alias("algo_b"), *KEY, F.lit(1.0 if measure == "jaccard" else 100.0).alias("value"))
    return cells.unionByName(same).groupBy("algo_a", *KEY).pivot("algo_b", names).agg(F.first("value"))


def reference_scores(domains: DataFrame, reference: DataFrame, tolerances: tuple[int, ...] = (1, 2), keys: DataFrame | None = None, repeats: bool = False) -> DataFrame:
    """(algorithm, chrom, resolution, tol, recall, precision, f1, jaccard); null without reference boundaries, 0 without own ones.

    ``reference`` has (chrom, resolution, start, end). Domains are sets. ``repeats``: a domain listed several times counts in ``jaccard`` as a
    left join of the two lists counts it, so shared ones are the pairs of equal domains and the measure may exceed 1.
    """
    keys = spine(domains) if keys is None else keys
    own, ref = boundaries(domains), boundaries(reference, *KEY)
    n_own = own.groupBy(*ALGO).agg(F.count(F.lit(1)).alias("n_own"))
    n_ref = ref.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_ref"))
    times = F.count(F.lit(1)) if repeats else F.max(F.lit(1))
    doms, refs = domains.groupBy(*ALGO, "start", "end").agg(times.alias("_own")), reference.groupBy(*KEY, "start", "end").agg(times.alias("_ref"))
    pairs = doms.join(refs, [*KEY, "start", "end"], "left")
    sizes = pairs.groupBy(*ALGO).agg(F.sum(F.col("_own") * F.coalesce("_ref", F.lit(0))).alias("shared"), F.sum(F.col("_own") * F.coalesce("_ref", F.lit(1))).alias("d_own"))
    ref_sizes = refs.groupBy(*KEY).agg(F.sum("_ref").alias("d_ref"))
    asked = keys.join(ref, KEY)
    out = None
    for tol in tolerances:
        found = near(own, ref, KEY, tol).groupBy(*ALGO).agg(F.count(F.lit(1)).alias("hit_own"))
        back = near(asked, own, ALGO, tol).groupBy(*ALGO).agg(F.count(F.lit(1)).alias("hit_ref"))
        part = keys.join(found, ALGO, "left").join(back, ALGO, "left").withColumn("tol", F.lit(tol))
        out = part if out is None else out.unionByName(part)
    out = out.join(n_own, ALGO, "left").join(n_ref, KEY, "left").join(sizes, ALGO, "left").join(ref_sizes, KEY, "left")
    out = out.fillna(0, ["hit_own", "hit_ref", "n_own", "n_ref", "shared", "d_own", "d_ref"])
    have = F.col("n_ref") > 0
    recall = F.col("hit_ref") / F.col("n_ref")
    precision = F.when(F.col("n_own") > 0, F.col("hit_own") / F.col("n_own")).otherwise(0.0)
    out = out.withColumn("recall", F.when(have, recall)).withColumn("precision", F.when(have, precision))
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-9)
    jaccard = F.col("shared") / (F.col("d_own") + F.col("d_ref") - F.col("shared"))
    return out.select(*ALGO, "tol", "recall", "precision", f1.alias("f1"), F.when(have, jaccard).alias("jaccard"))


def reference_table(domains: DataFrame, reference: DataFrame, tolerances: tuple[int, ...] = (1, 2), keys: DataFrame | None = None, repeats: bool = False) -> DataFrame:
    """One row a key, with columns tol{t}bin_{metric}."""
    long = reference_scores(domains, reference, tolerances, keys, repeats)
    metrics = ("recall", "precision", "f1", "jaccard")
    return long.groupBy(*ALGO).agg(*(F.max(F.when(F.col("tol") == t, F.col(m))).alias(f"tol{t}bin_{m}") for t in tolerances for m in metrics))


def aggregate_statistics(domains: DataFrame, sizes: DataFrame, consensus: DataFrame, reference: DataFrame | None = None) -> dict[str, DataFrame]:
    """The four report tables."""
    out = {"basic": basic_stats(domains, sizes, consensus), "pairwise_jaccard": pairwise_jaccard(domains), "pairwise_overlap": pairwise_overlap(domains)}
    return out if reference is None else out | {"reference_comparison": reference_table(domains, reference)}
