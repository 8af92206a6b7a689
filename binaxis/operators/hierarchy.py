"""Nested domains: parents and children, and the selection of one level set."""

from __future__ import annotations

from itertools import accumulate, repeat, takewhile

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import KEY

#: By what part a threshold falls, and thresholds, in least domains, where an axis is too short to fall.
FALL, SHORT = 0.7, (4, 3, 2)
#: Penalties of a sweep, in order; domains per Mb that are aimed at, and the bounds of that.
PENALTIES, PER_MB, BOUNDS = (0.1, 0.05, 0.02, 0.01, 0.005), (0.8, 2.5), (5, 200)
#: Bins of a bucket in the join of parents and children.
BUCKET = 64


def children(rows: DataFrame, keys: list[str], least: int = 1) -> DataFrame:
    """Pairs of a domain and those one level deeper that lie inside it and are long enough.

    Equi-joined on keys, depth and buckets of the axis: a child is looked for in the buckets that its parent covers, by where it starts.
    """
    at = lambda c: F.floor(F.col(c) / BUCKET)
    p = rows.select(*keys, F.col("depth").alias("parent_depth"), F.col("start_bin").alias("parent_start"), F.col("end_bin").alias("parent_end"), (F.col("depth") + 1).alias("depth"), F.explode(F.sequence(at("start_bin"), at("end_bin"))).alias("_bucket"))
    inside = (F.col("start_bin") >= F.col("parent_start")) & (F.col("end_bin") <= F.col("parent_end")) & (F.col("end_bin") - F.col("start_bin") >= least)
    return p.join(rows.select(*keys, "depth", "start_bin", "end_bin", at("start_bin").alias("_bucket")), [*keys, "depth", "_bucket"]).filter(inside).drop("_bucket")


def thresholds(n: int, low: int, least: int) -> list[int]:
    """Lengths above which a domain gives way to its children, from the mean one on, while two least domains fit."""
    falling = accumulate(repeat(FALL), lambda t, fall: int(t * fall), initial=n // max(1, low))
    return list(takewhile(lambda t: t >= 2 * least, falling)) or [k * least for k in SHORT]


def divide(rows: list[tuple[int, int, int]], n: int, low: int, high: int, least: int) -> list[tuple[int, int, int]]:
    """From the top level down, domains (start, end, depth) longer than a falling threshold give way to two or more children.

    Stops at a number between ``low`` and ``high``; otherwise the set whose number came nearest to the middle, the first of equals.
    """
    rows = [r for r in rows if r[2] > 0 and r[1] - r[0] >= least]
    if not rows:
        return []
    top, middle = min(r[2] for r in rows), (low + high) / 2
    now = [r for r in rows if r[2] == top]
    best = now
    for limit in thresholds(n, low, least):
        if not low <= len(now) <= high:
            now = [x for r in now for x in _replaced(r, rows, limit)]
        if abs(len(now) - middle) < abs(len(best) - middle):
            best = now
        if low <= len(now) <= high:
            best = now
            break
    return sorted(best)


def _replaced(r: tuple[int, int, int], rows: list[tuple[int, int, int]], limit: int) -> list[tuple[int, int, int]]:
    if r[1] - r[0] <= limit:
        return [r]
    inside = [x for x in rows if x[2] == r[2] + 1 and x[0] >= r[0] and x[1] <= r[1]]
    return inside if len(inside) >= 2 else [r]


def selected(rows: DataFrame, keys: list[str], least: int = 3, low: int = 20, high: int = 200) -> DataFrame:
    """(keys, start_bin, end_bin, depth): the chosen set of each key; a hierarchy is small, one group each.

    Columns ``n``, ``low``, ``high``, ``least`` of ``rows``, where they are, tell bins and aims of each key; else the last bin and the arguments do.
    """
    own = [c for c in ("n", "low", "high", "least") if c in rows.columns]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        aim = {"n": int(pdf["end_bin"].max()), "low": low, "high": high, "least": least} | {c: int(pdf[c].iloc[0]) for c in own}
        found = divide(list(zip(pdf["start_bin"].tolist(), pdf["end_bin"].tolist(), pdf["depth"].tolist())), aim["n"], aim["low"], aim["high"], aim["least"])
        out = pd.DataFrame(found, columns=["start_bin", "end_bin", "depth"])
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    kinds = dict(rows.dtypes)
    return rows.select(*keys, "start_bin", "end_bin", "depth", *own).groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "start_bin int, end_bin int, depth int"]))


def swept_domains(rows: DataFrame, n_bins: DataFrame, least_bins: int = 3, least_kb: int = 100, fallback: DataFrame | None = None) -> DataFrame:
    """(chrom, resolution, start, end): from the hierarchies of several penalties, that whose selected domains are on target for the chromosome's size.

    ``rows`` has (chrom, resolution, penalty, HIERARCHY), bins counted from 1; ``n_bins`` has (chrom, resolution, n). Penalties are tried in falling order: the first on target is taken, else
    that nearest to the middle of it, the first of equals. A chromosome without a hierarchy, or whose domains are all too short, takes those of ``fallback``.
    """
    mb = F.col("n") * F.col("resolution") / 1e6
    least = F.greatest(F.lit(least_bins), F.floor(F.lit(least_kb) * 1000 / F.col("resolution"))).cast("int")
    aims = n_bins.select(*KEY, "n", F.greatest(F.lit(BOUNDS[0]), F.floor(mb * PER_MB[0])).cast("int").alias("low"), F.least(F.lit(BOUNDS[1]), F.floor(mb * PER_MB[1])).cast("int").alias("high"), least.alias("least"))
    chosen = selected(rows.join(aims, KEY), [*KEY, "penalty"])
    counts = chosen.groupBy(*KEY, "penalty").agg(F.count(F.lit(1)).alias("_k")).join(aims, KEY)
    on = F.col("_k").between(F.col("low"), F.col("high"))
    order = Window.partitionBy(*KEY).orderBy(F.desc(on), F.when(on, F.lit(0.0)).otherwise(F.abs(F.col("_k") - (F.col("low") + F.col("high")) / 2)), F.desc("penalty"))
    best = counts.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select(*KEY, "penalty", "n", "least")
    start, end = (F.col("start_bin") - 1) * F.col("resolution"), F.least(F.col("end_bin"), F.col("n")) * F.col("resolution")
    found = chosen.join(best, [*KEY, "penalty"]).select(*KEY, start.cast("long").alias("start"), end.cast("long").alias("end"), (F.col("least") * F.col("resolution")).alias("_least"))
    found = found.filter(F.col("end") - F.col("start") >= F.col("_least")).drop("_least")
    return found if fallback is None else found.unionByName(fallback.select(*found.columns).join(found.select(*KEY).distinct(), KEY, "left_anti"))


def hierarchy_domains(rows: DataFrame, n_bins: DataFrame, least: int = 3, low: int = 20, high: int = 200) -> DataFrame:
    """(chrom, resolution, start, end) in bp from 1-based first bins; ends stay on the chromosome. ``rows`` has (chrom, resolution, HIERARCHY)."""
    key = ["chrom", "resolution"]
    found = selected(rows, key, least, low, high).join(n_bins, key)
    start, end = (F.col("start_bin") - 1) * F.col("resolution"), F.least(F.col("end_bin"), F.col("n")) * F.col("resolution")
    return found.select(*key, start.cast("long").alias("start"), end.cast("long").alias("end")).filter(F.col("end") - F.col("start") >= least * F.col("resolution"))
