"""Multiscale domains: optimal domain sets over a range of gammas, merged by persistence."""

from __future__ import annotations

import heapq
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import KEY
from .compare import pairwise_jaccard
from .segment import window_sums

#: The step of gamma, and the least windows of a length.
STEP, LEAST_WINDOWS = 0.05, 100
#: Groups of gammas of one chromosome.
SWEEP_GROUPS = 4
PER_MB, FLOORS = (0.8, 2.5), (10, 50)


def qualities(sums: np.ndarray, gamma: float, least_windows: int) -> np.ndarray:
    """q[d, a]: sum over d ** gamma of window [a, a + d) less the mean of its length, where positive; else -inf.

    Lengths of one bin, and lengths with fewer than ``least_windows`` windows, have none.
    """
    n = sums.shape[1] - 1
    out = np.full(sums.shape, -np.inf)
    for d in range(2, sums.shape[0]):
        windows = n - d + 1
        if windows >= least_windows:
            s = sums[d, :windows] / float(d) ** gamma
            s = np.round(s - s.mean(), 9)  # so that no choice hangs on the order of sums
            out[d, :windows] = np.where(s > 0, s, -np.inf)
    return out


def best_set(q: np.ndarray) -> list[tuple[int, int]]:
    """The windows (first, last bin) of the best set. ``inside[l]`` ends in a window at bin l, ``whole[l]`` covers bins 1 .. l.

    After a window comes another, or a gap of two bins or more: whole[l] = max(inside[l], max of inside up to l - 2).
    """
    n = q.shape[1] - 1
    whole, inside = np.zeros(n + 1), np.zeros(n + 1)
    from_, gap_to = np.zeros(n + 1, np.int64), np.full(n + 1, -1)
    best_end, best_at = 0.0, 0  # greatest of inside[0 .. l - 2], and the first place of it
    for l in range(2, n + 1):
        if inside[l - 2] > best_end:
            best_end, best_at = inside[l - 2], l - 2
        d = np.arange(min(l, q.shape[0] - 1), 1, -1)
        ways = whole[l - d] + q[d, l - d]
        k = int(np.argmax(ways))
        inside[l], from_[l] = ways[k], l - d[k]
        whole[l] = inside[l]
        if best_end > inside[l]:
            whole[l], gap_to[l] = best_end, best_at
    out, l = [], n
    while l > 1:
        if gap_to[l] >= 0:
            l = int(gap_to[l])
            continue
        if inside[l] > -np.inf:
            out.append((int(from_[l]), l - 1))
        l = int(from_[l])
    return out[::-1]


def best_sets(q: np.ndarray, k: int) -> list[tuple[float, list[tuple[int, int]]]]:
    """The ``k`` best different sets (score, windows) under the same rules, best first."""
    n = q.shape[1] - 1
    inside: list[list] = [[(0.0, ())], []]  # (score, windows from the last back, as nested pairs)
    whole: list[list] = [[(0.0, ())], [(0.0, ())]]
    before: list = []  # the best of inside[1 .. l - 2]
    for l in range(2, n + 1):
        d = np.arange(2, min(l, q.shape[0] - 1) + 1)
        own = q[d, l - d]
        ways = [(s + own[x], ((l - d[x], l - 1), w)) for x in np.flatnonzero(own > -np.inf).tolist() for s, w in whole[l - d[x]]]
        inside.append(heapq.nlargest(k, ways, key=lambda w: w[0]))
        if l > 2:
            before = heapq.nlargest(k, [*before, *inside[l - 2]], key=lambda w: w[0])
        whole.append(heapq.nlargest(k, [*inside[l], *before, (0.0, ())], key=lambda w: w[0]))  # a gap after a window, or no window at all
    out = []
    for score, w in whole[n]:
        windows = []
        while w:
            windows.append((int(w[0][0]), int(w[0][1])))
            w = w[1]
        out.append((score, windows[::-1]))
    return out


def gammas_up_to(most: float, step: float = STEP) -> list[float]:
    return [round(k * step, 10) for k in range(int((most + 1e-5) / step) + 1)]


def domain_sets(c: DataFrame, gammas: list[float], least_windows: int = LEAST_WINDOWS, k: int = 1) -> DataFrame:
    """(chrom, resolution, gamma, rank, weight, first, last): best domain sets of each gamma, in bins, ends included; weight 1 for the best.

    Contacts enter by their logarithm. Gammas are dealt to SWEEP_GROUPS groups of a chromosome, each a task's own, which sums all
    windows once for its gammas: n squared numbers, so a group a gamma would send the contacts and sum them far more often.
    """
    from . import signals as S

    logs = c.filter("v > 0").join(S.n_bins(c), KEY).select(*KEY, "n", "i", "j", F.log("v").alias("v"))
    groups = min(SWEEP_GROUPS, len(gammas))
    spread = logs.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).groupBy(*KEY, "group")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        sums = window_sums(pdf["i"].to_numpy(), pdf["j"].to_numpy(), pdf["v"].to_numpy(), n, n)
        rows = []
        for g in gammas[int(pdf["group"].iloc[0]) :: groups]:
            q = qualities(sums, g, least_windows)
            found = [(1.0, best_set(q))] if k == 1 else best_sets(q, k)
            top = found[0][0]
            rows += [(pdf["chrom"].iloc[0], int(pdf["resolution"].iloc[0]), g, r, score / top if top else 1.0, a, b) for r, (score, windows) in enumerate(found) for a, b in windows]
        return pd.DataFrame(rows, columns=["chrom", "resolution", "gamma", "rank", "weight", "first", "last"])

    return spread.applyInPandas(run, "chrom string, resolution int, gamma double, rank int, weight double, first long, last long")


def persistence(sets: DataFrame, *keys: str) -> DataFrame:
    """(keys, first, last, weight): how much of the ensemble has each domain."""
    return sets.groupBy(*(keys or KEY), "first", "last").agg(F.sum("weight").alias("weight"))


def schedule(rows: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """The disjoint intervals (ends included) of greatest total weight."""
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    ends = [r[1] for r in rows]
    before = [bisect_left(ends, r[0]) for r in rows]  # intervals that end before this one starts
    best = [0.0]
    for j, r in enumerate(rows):
        best.append(max(best[-1], r[2] + best[before[j]]))
    out, j = [], len(rows)
    while j:
        if best[j] != best[j - 1]:
            out.append(rows[j - 1][:2])
            j = before[j - 1]
        else:
            j -= 1
    return sorted(out)


def scheduled(weighted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, first, last): for each key the disjoint domains of greatest total weight."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = schedule(list(zip(pdf["first"].tolist(), pdf["last"].tolist(), pdf["weight"].tolist())))
        out = pd.DataFrame(kept, columns=["first", "last"])
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    kinds = dict(weighted.dtypes)
    return weighted.select(*keys, "first", "last", "weight").groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "first long, last long"]))


def gamma_domains(c: DataFrame, gammas: list[float], least_windows: int = LEAST_WINDOWS, inclusive_end: bool = False) -> DataFrame:
    """(gamma, chrom, resolution, start, end): for each configured gamma the merged domains of all steps from 0 up to it.

    Each step's optimum is found once and shared. Ends are half-open, or with ``inclusive_end`` one less.
    """
    steps = sorted({g for most in gammas for g in gammas_up_to(most)})
    sets = domain_sets(c, steps, least_windows)
    tops = F.array(*(F.lit(float(g)) for g in gammas))
    ensembles = sets.withColumn("top", F.explode(F.filter(tops, lambda t: t + 1e-5 >= F.col("gamma")))).withColumnRenamed("gamma", "step")
    merged = scheduled(persistence(ensembles, *KEY, "top"), [*KEY, "top"])
    end = (F.col("last") + 1) * F.col("resolution") - (1 if inclusive_end else 0)
    return merged.select(F.col("top").alias("gamma"), *KEY, (F.col("first") * F.col("resolution")).alias("start"), end.alias("end"))


def stability(per_gamma: DataFrame) -> DataFrame:
    """(gamma, chrom, resolution, n_tads, stability): mean Jaccard of a gamma's domains with those of each other gamma; two empty sets share nothing."""
    named = per_gamma.withColumn("algorithm", F.col("gamma").cast("string"))
    pairs = pairwise_jaccard(named, ordered=True, both_empty=0.0).groupBy(F.col("algo_a").alias("algorithm"), *KEY).agg(F.avg("jaccard").alias("stability"))
    counts = named.groupBy("algorithm", "gamma", *KEY).agg(F.count(F.lit(1)).alias("n_tads"))
    spine = named.select("algorithm", "gamma").distinct().join(named.select(*KEY).distinct(), F.lit(True))
    return spine.join(counts, ["algorithm", "gamma", *KEY], "left").join(pairs, ["algorithm", *KEY], "left").select("gamma", *KEY, F.coalesce("n_tads", F.lit(0)).alias("n_tads"), F.coalesce("stability", F.lit(0.0)).alias("stability"))


def choose_gamma(stable: DataFrame, sizes: DataFrame) -> DataFrame:
    """(chrom, resolution, gamma): the most stable gamma whose count suits the chromosome's size, else the count nearest to the middle; the first of equals."""
    mb = F.col("size") / 1e6
    lo, hi = F.greatest(F.lit(FLOORS[0]), F.floor(mb * PER_MB[0])), F.greatest(F.lit(FLOORS[1]), F.floor(mb * PER_MB[1]))
    rows = stable.join(sizes.select("chrom", "size"), "chrom").withColumn("_on", F.col("n_tads").between(lo, hi)).withColumn("_away", F.abs(F.col("n_tads") - (lo + hi) / 2))
    best = Window.partitionBy(*KEY).orderBy(F.desc("_on"), F.when(F.col("_on"), -F.round("stability", 9)).otherwise(F.col("_away")), "gamma")
    return rows.withColumn("_n", F.row_number().over(best)).filter("_n = 1").select(*KEY, "gamma")


def multiscale_domains(c: DataFrame, sizes: DataFrame, gammas: list[float], least_windows: int = LEAST_WINDOWS, inclusive_end: bool = False) -> DataFrame:
    """Domains of each chromosome at its chosen gamma."""
    each = gamma_domains(c, gammas, least_windows, inclusive_end)
    if len(gammas) == 1:
        return each.drop("gamma")
    return each.join(choose_gamma(stability(each), sizes), [*KEY, "gamma"]).select(*KEY, "start", "end")
