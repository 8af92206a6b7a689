"""Segmentation by dynamic programming, one chromosome a group: flank contrast with a penalty sweep."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import KEY

#: Penalties tried, in order; segments per Mb that are aimed at, and the bounds of that.
PENALTIES = (2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.08, 0.05, 0.03, 0.01)
PER_MB, BOUNDS = (0.8, 2.5), (5, 200)


def window_sums(i: np.ndarray, j: np.ndarray, v: np.ndarray, n: int, most: int) -> np.ndarray:
    """t[d, a]: sum of the contacts a <= i <= j < a + d, for all window lengths d up to ``most``; memory n times ``most``."""
    most = min(most, n)
    reach = np.zeros((most, n))
    near = j - i < most
    np.add.at(reach, (j[near] - i[near], i[near]), v[near])
    np.cumsum(reach, axis=0, out=reach)  # row k: contacts of a with a .. a + k
    t = np.zeros((most + 1, n + 1))
    for d in range(1, most + 1):
        t[d, : n - d + 1] = t[d - 1, 1 : n - d + 2] + reach[d - 1, : n - d + 1]
    return t


def flank_scores(i: np.ndarray, j: np.ndarray, oe: np.ndarray, n: int, least: int, most: int) -> np.ndarray:
    """score[d, a]: mean of the square block of window [a, a + d) less the mean of its flanks of length d; -inf where no window fits."""
    most = min(most, n)
    t = window_sums(i, j, oe, n, 2 * most)
    diag = np.zeros(n + 1)
    np.add.at(diag, i[i == j] + 1, oe[i == j])
    diag = np.cumsum(diag)
    out = np.full((most + 1, n + 1), -np.inf)
    for d in range(max(1, least), most + 1):
        a = np.arange(n - d + 1)
        b, lo, hi = a + d, np.maximum(0, a - d), np.minimum(n, a + 2 * d)
        own = t[d, a]
        left = t[b - lo, lo] - t[a - lo, lo] - own
        right = t[hi - a, a] - own - t[hi - b, b]
        area = d * ((a - lo) + (hi - b))
        flank = np.divide(left + right, area, out=np.zeros(len(a)), where=area > 0)
        out[d, a] = np.round((2 * own - (diag[b] - diag[a])) / (d * d) - flank, 9)  # so that no choice hangs on the order of sums
    return out


def cover(scores: np.ndarray, penalty: float, least: int, n: int) -> list[tuple[int, int]]:
    """Segments that cover [0, n) with the greatest sum of scores less a penalty each; of equals, the longer last segment.

    If no sizes add up to n, the last segment that ends nearest to n is drawn out to it.
    """
    most = scores.shape[0] - 1
    best, back = np.full(n + 1, -np.inf), np.full(n + 1, -1)
    best[0] = 0.0
    for b in range(least, n + 1):
        d = np.arange(min(most, b), least - 1, -1)
        if len(d):
            sums = best[b - d] + scores[d, b - d] - penalty
            k = int(np.argmax(sums))
            if sums[k] > -np.inf:
                best[b], back[b] = sums[k], b - d[k]
    if back[n] < 0:
        reached = np.flatnonzero(back[:n] >= 0)
        back[n] = back[reached[-1]] if len(reached) else 0
    out, b = [], n
    while b > 0:
        out.append((int(back[b]), b))
        b = int(back[b])
    return out[::-1]


def score_rows(oe: DataFrame, least: int, most: int) -> DataFrame:
    """(chrom, resolution, n, b, scores): the scores of all windows that end at b, of lengths 0 to ``most``; once for all penalties. ``oe`` has (i, j, oe, n)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        scores = flank_scores(pdf["i"].to_numpy(), pdf["j"].to_numpy(), pdf["oe"].to_numpy(), n, least, most)
        d = np.arange(scores.shape[0])
        own = [scores[d[: b + 1], b - d[: b + 1]] for b in range(n + 1)]
        return pd.DataFrame({"chrom": pdf["chrom"].iloc[0], "resolution": int(pdf["resolution"].iloc[0]), "n": n, "b": range(n + 1), "scores": own})

    return oe.groupBy(*KEY).applyInPandas(run, "chrom string, resolution int, n long, b long, scores array<double>")


def sweep(oe: DataFrame, least: int, most: int, penalties=PENALTIES) -> DataFrame:
    """(chrom, resolution, n_bins, ord, penalty, s, e): the cover of each chromosome at every penalty, each a group of its own. ``oe`` has (i, j, oe, n)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("b")
        n = int(pdf["n"].iloc[0])
        scores = np.full((min(most, n) + 1, n + 1), -np.inf)
        for b, own in zip(pdf["b"].tolist(), pdf["scores"]):
            scores[np.arange(len(own)), b - np.arange(len(own))] = own
        out = pd.DataFrame(cover(scores, float(pdf["penalty"].iloc[0]), least, n), columns=["s", "e"])
        for at, c in enumerate(("chrom", "resolution", "n", "ord", "penalty")):
            out.insert(at, c, pdf[c].iloc[0])
        return out.rename(columns={"n": "n_bins"})

    each = score_rows(oe, least, most).select("*", F.posexplode(F.array(*map(F.lit, map(float, penalties)))).alias("ord", "penalty"))
    return each.groupBy(*KEY, "ord").applyInPandas(run, "chrom string, resolution int, n_bins long, ord int, penalty double, s long, e long")


def choose_penalty(swept: DataFrame) -> DataFrame:
    """(chrom, resolution, ord, penalty, n_tads): the first penalty whose count is on target, else the count nearest to its middle."""
    counts = swept.groupBy(*KEY, "n_bins", "ord", "penalty").agg(F.count(F.lit(1)).alias("n_tads"))
    mb = F.col("n_bins") * F.col("resolution") / 1e6
    lo, hi = F.greatest(F.lit(BOUNDS[0]), F.floor(mb * PER_MB[0])), F.least(F.lit(BOUNDS[1]), F.floor(mb * PER_MB[1]))
    hit = (F.col("n_tads") >= lo) & (F.col("n_tads") <= hi)
    away = F.abs(F.col("n_tads") - (lo + hi) / 2)
    best = Window.partitionBy(*KEY).orderBy(F.desc("_hit"), F.when(F.col("_hit"), F.lit(0.0)).otherwise(F.col("_away")), "ord")
    return counts.withColumn("_hit", hit).withColumn("_away", away).withColumn("_n", F.row_number().over(best)).filter("_n = 1").select(*KEY, "ord", "penalty", "n_tads")


def flank_contrast_domains(c: DataFrame, least: int = 4, most: int = 200, most_distance: int | None = None, penalty: float | None = None) -> DataFrame:
    """Domains of ``least`` to ``most`` bins that cover each chromosome, from observed over expected contacts."""
    from . import signals as S

    near = c if most_distance is None else c.filter(F.col("j") - F.col("i") < most_distance)
    oe = S.observed_over_expected(near).join(S.n_bins(c), KEY).select(*KEY, "i", "j", "oe", "n")
    swept = sweep(oe, least, most, PENALTIES if penalty is None else (penalty,))
    kept = swept.join(choose_penalty(swept).select(*KEY, "ord"), [*KEY, "ord"])
    return kept.filter(F.col("e") - F.col("s") >= least).select(*KEY, (F.col("s") * F.col("resolution")).alias("start"), (F.col("e") * F.col("resolution")).alias("end"))
