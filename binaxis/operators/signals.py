"""One-dimensional signals over the bin axis, computed from sparse contacts.

A contact (i <= j) is added to every bin whose window it lies in; bins are then summed. No dense matrix
is built, sums are partial before they shuffle, and rows grow with contacts times window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import KEY

DIGITS = 9  # signals are rounded so that comparisons do not hang on the order of sums


def binned(contacts: DataFrame) -> DataFrame:
    """(chrom, resolution, i, j, v) by bin number, i <= j; repeated pairs add up."""
    lo, hi = F.least("bin_i", "bin_j"), F.greatest("bin_i", "bin_j")
    as_bin = lambda c: F.floor(c / F.col("resolution")).cast("long")
    return contacts.groupBy(*KEY, as_bin(lo).alias("i"), as_bin(hi).alias("j")).agg(F.sum("count").alias("v"))


def n_bins(c: DataFrame) -> DataFrame:
    return c.groupBy(*KEY).agg((F.max("j") + 1).alias("n"))


def bins(c: DataFrame) -> DataFrame:
    """(chrom, resolution, n, bin) for every bin from 0 to the last one seen."""
    return n_bins(c).select(*KEY, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("bin"))


def band_sum(c: DataFrame, lo: str, hi: str, value: Column | None = None) -> DataFrame:
    """(chrom, resolution, bin, s): contacts added to all bins from ``lo`` to ``hi``, expressions in i and j."""
    spread = c.filter(f"{lo} <= {hi}").select(*KEY, (F.col("v") if value is None else value).alias("v"), F.explode(F.expr(f"sequence({lo}, {hi})")).alias("bin"))
    return spread.groupBy(*KEY, "bin").agg(F.sum("v").alias("s"))


def insulation(c: DataFrame, window: int = 5) -> DataFrame:
    """log1p of the contacts across each bin within the window, over their mean."""
    s = band_sum(c, f"greatest(i, j - {window})", f"least(i + {window}, j)")
    raw = bins(c).join(s, [*KEY, "bin"], "left").withColumn("x", F.log1p(F.coalesce("s", F.lit(0.0))))
    mean = F.avg("x").over(Window.partitionBy(*KEY))
    return raw.select(*KEY, "n", "bin", F.round(F.when(mean > 0, F.col("x") / mean).otherwise(F.col("x")), DIGITS).alias("x"))


def bin_scores(c: DataFrame, windows: tuple[int, ...]) -> DataFrame:
    """(chrom, resolution, w, n, bin, x): for each window the mean of the square block before each bin minus that of the block after; null near the ends.

    Both blocks of all windows are one explode and one sum: contacts of the block after count as negative.
    """
    value = F.col("v") * F.when(F.col("i") < F.col("j"), 2).otherwise(1)
    each = c.select(*KEY, "i", "j", value.alias("v"), F.explode(F.array(*map(F.lit, windows))).alias("w")).filter("j - i <= w - 1")
    up, down = F.sequence(F.col("j") + 1, F.col("i") + F.col("w")), F.sequence(F.col("j") - F.col("w"), F.col("i") - 1)
    at = F.concat(F.transform(up, lambda k: F.struct(k.alias("bin"), F.lit(1).alias("sign"))), F.transform(down, lambda k: F.struct(k.alias("bin"), F.lit(-1).alias("sign"))))
    sums = each.select(*KEY, "w", "v", F.explode(at).alias("_at")).groupBy(*KEY, "w", F.col("_at.bin").alias("bin")).agg(F.sum(F.col("v") * F.col("_at.sign")).alias("s"))
    every = bins(c).select("*", F.explode(F.array(*map(F.lit, windows))).alias("w"))
    inside = (F.col("bin") >= F.col("w")) & (F.col("bin") < F.col("n") - F.col("w"))
    score = F.coalesce("s", F.lit(0.0)) / (F.col("w") * F.col("w"))
    return every.join(sums, [*KEY, "w", "bin"], "left").select(*KEY, "w", "n", "bin", F.when(inside, F.round(score, DIGITS)).alias("x"))


def bin_score(c: DataFrame, window: int) -> DataFrame:
    return bin_scores(c, (window,)).drop("w")


def directionality(c: DataFrame, window: int = 10) -> DataFrame:
    """Signed chi-square of the contacts downstream and upstream of each bin; 0 near the ends and without contacts."""
    near = c.filter(f"j - i between 1 and {window}")
    up = near.groupBy(*KEY, F.col("j").alias("bin")).agg(F.sum("v").alias("u"))
    down = near.groupBy(*KEY, F.col("i").alias("bin")).agg(F.sum("v").alias("d"))
    rows = bins(c).join(up, [*KEY, "bin"], "left").join(down, [*KEY, "bin"], "left").fillna(0.0, ["u", "d"])
    e = (F.col("u") + F.col("d")) / 2
    chi = F.signum(F.col("d") - F.col("u")) * ((F.col("d") - e) ** 2 / e + (F.col("u") - e) ** 2 / e)
    inside = (F.col("bin") >= window) & (F.col("bin") < F.col("n") - window) & (e > 0)
    return rows.select(*KEY, "n", "bin", F.when(inside, F.round(chi, DIGITS)).otherwise(0.0).alias("x"))


def flank_mean(c: DataFrame, most: int = 10) -> DataFrame:
    """Mean of the block between the bins before and from each bin on; window min(most, n div 4); 0 near the ends."""
    sized = c.join(n_bins(c), KEY).withColumn("w", F.least(F.lit(most), F.expr("n div 4")).cast("long"))
    s = band_sum(sized, "greatest(i + 1, j - w + 1)", "least(i + w, j)")
    w = F.least(F.lit(most), F.expr("n div 4")).cast("long")
    rows = bins(c).withColumn("w", w).join(s, [*KEY, "bin"], "left")
    inside = (F.col("bin") >= F.col("w")) & (F.col("bin") < F.col("n") - F.col("w")) & (F.col("w") > 0)
    return rows.select(*KEY, "n", "bin", F.when(inside, F.round(F.coalesce("s", F.lit(0.0)) / (F.col("w") * F.col("w")), DIGITS)).otherwise(0.0).alias("x"))


def kernel(sigma: float) -> list[tuple[int, float]]:
    """(offset, weight) of a Gaussian cut at four sigmas, weights summing to one."""
    r = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [(k - r, x / sum(w)) for k, x in enumerate(w)]


def smooth(signal: DataFrame, sigma: float) -> DataFrame:
    """Gaussian smoothing, the axis reflected at its ends. Each bin, and each mirror image of it, adds to its neighbours."""
    weights = kernel(sigma)
    r = weights[-1][0]
    turns = F.sequence(-F.floor(F.lit(r) / (2 * F.col("n"))) - 1, F.floor(F.lit(r) / (2 * F.col("n"))) + 1)
    images = signal.withColumn("_turn", F.explode(turns)).select(*KEY, "n", "x", F.explode(F.array(F.col("bin") + 2 * F.col("n") * F.col("_turn"), -F.col("bin") - 1 + 2 * F.col("n") * F.col("_turn"))).alias("_at"))
    images = images.filter((F.col("_at") >= -r) & (F.col("_at") < F.col("n") + r))
    steps = F.explode(F.array(*(F.struct(F.lit(o).alias("o"), F.lit(w).alias("w")) for o, w in weights))).alias("_k")
    spread = images.select("*", steps).select(*KEY, "n", (F.col("_at") - F.col("_k.o")).alias("bin"), (F.col("x") * F.col("_k.w")).alias("_y"))
    return spread.filter("bin >= 0 and bin < n").groupBy(*KEY, "n", "bin").agg(F.round(F.sum("_y"), DIGITS).alias("x"))


def strict_minima(signal: DataFrame, order: int | Column = 1, most: int | None = None, keys: list[str] = KEY) -> DataFrame:
    """Bins less than all neighbours within ``order`` (a number, or a column of at most ``most``), the two end bins left out."""
    own = Window.partitionBy(*keys).orderBy("bin")
    reach = order if isinstance(order, int) else most
    less = F.lit(True)
    for k in range(1, reach + 1):
        near = F.coalesce(F.col("x") < F.lag("x", k).over(own), F.lit(True)) & F.coalesce(F.col("x") < F.lead("x", k).over(own), F.lit(True))
        less = less & (near if isinstance(order, int) else (F.lit(k) > order) | near)
    return signal.withColumn("_less", less).filter(F.col("_less") & (F.col("bin") > 0) & (F.col("bin") < F.col("n") - 1)).drop("_less")


def domains_between(marks: DataFrame, spine: DataFrame, last: str = "n", least: int = 1, keys: list[str] = KEY) -> DataFrame:
    """(keys, start, end): neighbours among 0, the marked bins and ``last``, an expression in n; in bp."""
    ends = spine.select(*keys, F.explode(F.array(F.lit(0).cast("long"), F.expr(last).cast("long"))).alias("bin"))
    all_ = marks.select(*keys, F.col("bin").cast("long").alias("bin")).unionByName(ends).distinct()
    nxt = F.lead("bin").over(Window.partitionBy(*keys).orderBy("bin"))
    return all_.withColumn("_to", nxt).filter((F.col("_to") - F.col("bin")) >= least).select(*keys, (F.col("bin") * F.col("resolution")).alias("start"), (F.col("_to") * F.col("resolution")).alias("end"))


def expected(c: DataFrame) -> DataFrame:
    """(chrom, resolution, d, n, expected): mean of the positive contacts at each distance."""
    return c.filter("v > 0").groupBy(*KEY, (F.col("j") - F.col("i")).alias("d")).agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("expected"))


def observed_over_expected(c: DataFrame) -> DataFrame:
    """Contacts over the mean of their distance; the mean is summed per distance first, so no distance is one task's load."""
    return c.withColumn("d", F.col("j") - F.col("i")).join(expected(c).select(*KEY, "d", "expected"), [*KEY, "d"]).select(*KEY, "i", "j", "v", (F.col("v") / F.col("expected")).alias("oe"))


def symmetrized(contacts: DataFrame) -> DataFrame:
    swapped = contacts.filter("bin_i <> bin_j").select(*KEY, F.col("bin_j").alias("bin_i"), F.col("bin_i").alias("bin_j"), "count")
    return contacts.select(*KEY, "bin_i", "bin_j", "count").unionByName(swapped)


def merged_pairs(contacts: DataFrame, how: str = "max") -> DataFrame:
    """One row for each unordered pair of a table that may hold both orders: their maximum or mean (0 for an absent one)."""
    lo, hi = F.least("bin_i", "bin_j"), F.greatest("bin_i", "bin_j")
    if how == "max":
        return contacts.groupBy(*KEY, lo.alias("bin_i"), hi.alias("bin_j")).agg(F.max("count").alias("count"))
    grouped = contacts.groupBy(*KEY, lo.alias("bin_i"), hi.alias("bin_j")).agg(F.sum("count").alias("_s"))
    return grouped.select(*KEY, "bin_i", "bin_j", F.when(F.col("bin_i") == F.col("bin_j"), F.col("_s")).otherwise(F.col("_s") / 2).alias("count"))


def distance_masked(contacts: DataFrame, most_bins: int) -> DataFrame:
    return contacts.filter(F.col("bin_j") - F.col("bin_i") < F.lit(most_bins) * F.col("resolution"))


def size_means(c: DataFrame, gammas: list[float], least: int = 100) -> DataFrame:
    """(chrom, resolution, gamma, d, n, mu): mean of sums of contacts inside windows of d > 1 bins over d ** gamma; null under ``least`` windows.

    The number of windows of d bins that hold a contact grows by one with each d from its own length on, until windows that start at
    the first bin, and then those that end at the last, are used up. So a contact turns the sum of a size at three sizes, and two running
    sums over sizes give all of them: rows grow with contacts and bins, not with pairs of bins.
    """
    n = n_bins(c)
    turns = F.array(F.struct((F.col("j") - F.col("i") + 1).alias("d"), F.col("v").alias("by")), F.struct((F.col("j") + 2).alias("d"), (-F.col("v")).alias("by")), F.struct((F.col("n") - F.col("i") + 1).alias("d"), (-F.col("v")).alias("by")))
    turned = c.join(n, KEY).select(*KEY, F.inline(turns)).groupBy(*KEY, "d").agg(F.sum("by").alias("_by"))
    sizes = n.select(*KEY, "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("d"))
    upto = Window.partitionBy(*KEY).orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    sums = sizes.join(turned, [*KEY, "d"], "left").withColumn("_step", F.sum(F.coalesce("_by", F.lit(0.0))).over(upto)).withColumn("_sum", F.sum("_step").over(upto))
    totals = sums.filter("d > 1").withColumn("n", F.col("n") - F.col("d") + 1).select(*KEY, "d", "n", (F.col("_sum") / F.col("n")).alias("_mean"))
    each = totals.withColumn("gamma", F.explode(F.array(*map(F.lit, gammas))))
    return each.select(*KEY, "gamma", "d", "n", F.when(F.col("n") >= least, F.col("_mean") / F.pow(F.col("d"), F.col("gamma"))).alias("mu"))
