"""Spectral segmentation: nearest-neighbour kernel, leading eigenvectors, penalised least squares along the axis."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import KEY

#: Neighbours, reach of the search in bins, dimensions, sampled bins for the kernel width, and domains aimed at.
NEIGHBOURS, REACH, DIMENSIONS, SAMPLED, AIM = 20, 500, 32, 200, (20, 200)


def dense(i: np.ndarray, j: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    m = np.zeros((n, n))
    m[i, j] = v
    m[j, i] = v
    return m


def affinity(rows: np.ndarray, neighbours: int = NEIGHBOURS, reach: int = REACH) -> np.ndarray:
    """Gaussian weights between each row and its nearest ones within ``reach``; both directions add up, so mutual neighbours count twice.

    The width is the median positive squared distance among SAMPLED rows. Ties go to the lower row.
    """
    n = len(rows)
    picked = rows[np.linspace(0, n - 1, min(SAMPLED, n), dtype=int)]
    sq = (picked**2).sum(1)
    apart = np.clip(sq[:, None] + sq - 2 * picked @ picked.T, 0, None)
    width = np.median(apart[apart > 0]) if (apart > 0).any() else 1.0
    out, norms = np.zeros((n, n)), (rows**2).sum(1)
    for i in range(n):
        lo, hi = max(0, i - reach), min(n, i + reach + 1)
        d = np.clip(norms[lo:hi] + norms[i] - 2 * rows[lo:hi] @ rows[i], 0, None)
        d[i - lo] = -1.0  # itself first, then left out
        near = np.argsort(d, kind="stable")[1 : min(neighbours, n - 1) + 1]
        w = np.exp(-d[near] / (2 * width + 1e-12))
        np.add.at(out, (i, lo + near), w)
        np.add.at(out, (lo + near, i), w)
    return out


def embed(weights: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Rows of the leading eigenvectors of the normalised kernel by magnitude, the first left out, at unit length."""
    root = 1 / np.sqrt(np.maximum(weights.sum(1), 1e-12))
    values, vectors = np.linalg.eigh(weights * root[:, None] * root)
    k = min(dimensions + 1, len(values))
    largest = np.argsort(-np.abs(values), kind="stable")[:k]
    picked = vectors[:, largest[np.argsort(-values[largest], kind="stable")][1:]]
    return picked / np.maximum(np.linalg.norm(picked, axis=1, keepdims=True), 1e-12)


class Costs:
    """Squared distances of stretches of rows from their means, from running sums."""

    def __init__(self, rows: np.ndarray):
        self.sums = np.vstack([np.zeros(rows.shape[1]), np.cumsum(rows, axis=0)])
        self.squares = np.append(0.0, np.cumsum((rows**2).sum(1)))

    def to(self, b: int, a: np.ndarray) -> np.ndarray:
        s = self.sums[b] - self.sums[a]
        return self.squares[b] - self.squares[a] - (s**2).sum(1) / (b - a)


def least_squares_cut(costs: Costs, penalty: float, least: int) -> list[int]:
    """Right ends of the segments with least cost plus penalties; of equals the longest last segment."""
    n = len(costs.squares) - 1
    best, back = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
    best[0] = 0.0
    for b in range(least, n + 1):
        a = np.arange(0, b - least + 1)
        total = best[a] + np.round(costs.to(b, a), 9) + penalty  # so that no choice hangs on the order of sums
        k = int(np.argmin(total))
        best[b], back[b] = total[k], k
    out, b = [], n
    while b > 0:
        out.append(b)
        b = int(back[b])
    return out[::-1]


#: Fixed values of the grid: its ends in total variances, its least lower end in bins, its least span, its penalties.
GRID_ENDS, GRID_LOW, GRID_SPAN, GRID_SIZE = (0.05, 20.0), 0.001, 10, 20


def penalty_grid(rows: np.ndarray, size: int = GRID_SIZE) -> np.ndarray:
    n = len(rows)
    typical = float(np.trace(np.atleast_2d(np.cov(rows.T)))) if n > 2 else 1.0
    low = max(typical * GRID_ENDS[0], n * GRID_LOW)
    return np.logspace(np.log10(low), np.log10(max(typical * GRID_ENDS[1], low * GRID_SPAN)), size)


def _caller(dimensions: int, least_kb: int, penalties):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n, res = int(pdf["n"].iloc[0]), int(pdf["resolution"].iloc[0])
        columns = ["chrom", "resolution", "ord", "penalty", "s", "e"]
        if n < 10:
            return pd.DataFrame(columns=columns)
        rows = embed(affinity(np.log1p(dense(pdf["i"].to_numpy(), pdf["j"].to_numpy(), pdf["v"].to_numpy(), n))), dimensions)
        costs, least, out = Costs(rows), max(3, least_kb * 1000 // res), []
        for k, p in enumerate(penalty_grid(rows) if penalties is None else penalties):
            ends = least_squares_cut(costs, float(p), least)
            out += [(pdf["chrom"].iloc[0], res, k, float(p), s, e) for s, e in zip([0, *ends], ends)]
        return pd.DataFrame(out, columns=columns)

    return run


def choose_elbow(swept: DataFrame, aim: tuple[int, int] = AIM) -> DataFrame:
    """(chrom, resolution, ord, penalty, n_tads): after the steepest change of the count among penalties on target; else the nearest to the middle.

    The count on which this rests is one less than the segments.
    """
    counts = swept.groupBy(*KEY, "ord", "penalty").agg((F.count(F.lit(1)) - 1).alias("n_tads"))
    own = Window.partitionBy(*KEY).orderBy("ord")
    on = counts.filter(F.col("n_tads").between(*aim)).withColumn("_step", F.coalesce(F.abs(F.col("n_tads") - F.lag("n_tads").over(own)), F.lit(-1))).withColumn("_on", F.lit(1))
    off = counts.withColumn("_step", -F.abs(F.col("n_tads") - sum(aim) / 2)).withColumn("_on", F.lit(0))
    best = Window.partitionBy(*KEY).orderBy(F.desc("_on"), F.desc("_step"), "ord")
    return on.withColumn("_step", F.col("_step").cast("double")).unionByName(off).withColumn("_n", F.row_number().over(best)).filter("_n = 1").select(*KEY, "ord", "penalty", "n_tads")


def spectral_domains(c: DataFrame, dimensions: int = DIMENSIONS, least_kb: int = 100, penalty: float | None = None) -> DataFrame:
    """Domains from the spectral embedding of each chromosome's bins. A chromosome's matrix is one task's: limit them by ``plans.eligible``."""
    from . import signals as S

    rows = c.join(S.n_bins(c), KEY).select(*KEY, "n", "i", "j", "v")
    swept = rows.groupBy(*KEY).applyInPandas(_caller(dimensions, least_kb, None if penalty is None else (penalty,)), "chrom string, resolution int, ord int, penalty double, s long, e long")
    kept = swept.join(choose_elbow(swept).select(*KEY, "ord"), [*KEY, "ord"])
    return kept.select(*KEY, (F.col("s") * F.col("resolution")).alias("start"), (F.col("e") * F.col("resolution")).alias("end"))
