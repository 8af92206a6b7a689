"""Hidden states of the directionality signal, and domains from their pattern."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import KEY
from . import minima as M
from . import signals as S


def fit_states(x: np.ndarray, states: int = 3, rounds: int = 100, tolerance: float = 1e-2) -> np.ndarray:
    """Most likely states of a Gaussian hidden Markov model fitted to ``x``, numbered by rising mean.

    Means start at quantiles, the rest evenly; EM stops after ``rounds`` or when the likelihood gains less than ``tolerance``.
    """
    n = len(x)
    mean = np.quantile(x, np.linspace(0.15, 0.85, states))
    var = np.full(states, max(x.var(), 1e-3))
    start, move = np.full(states, 1 / states), np.full((states, states), 1 / states)
    before = -np.inf
    for _ in range(rounds):
        log_p = -0.5 * (np.log(2 * np.pi * var) + (x[:, None] - mean) ** 2 / var)
        top = log_p.max(1)
        p = np.exp(log_p - top[:, None])
        ahead, scale, back = np.empty((n, states)), np.empty(n), np.ones((n, states))
        a = start * p[0]
        for t in range(n):
            if t:
                a = (ahead[t - 1] @ move) * p[t]
            scale[t] = max(a.sum(), 1e-300)
            ahead[t] = a / scale[t]
        for t in range(n - 2, -1, -1):
            back[t] = move @ (p[t + 1] * back[t + 1]) / scale[t + 1]
        weight = ahead * back
        weight /= weight.sum(1, keepdims=True)
        pairs = ahead[:-1].T @ (p[1:] * back[1:] / scale[1:, None]) * move
        start, move = weight[0], (pairs + 1e-12) / (pairs + 1e-12).sum(1, keepdims=True)
        total = weight.sum(0) + 1e-12
        mean = (weight * x[:, None]).sum(0) / total
        var = np.maximum((weight * (x[:, None] - mean) ** 2).sum(0) / total, 1e-3)
        now = np.log(scale).sum() + top.sum()
        if now - before < tolerance:
            break
        before = now
    order = np.argsort(mean, kind="stable")
    log_p = -0.5 * (np.log(2 * np.pi * var) + (x[:, None] - mean) ** 2 / var)
    log_move, best = np.log(move + 1e-300), np.log(start + 1e-300) + log_p[0]
    came = np.zeros((n, states), np.int64)
    for t in range(1, n):
        ways = best[:, None] + log_move
        came[t] = ways.argmax(0)
        best = ways.max(0) + log_p[t]
    path = np.empty(n, np.int64)
    path[-1] = best.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = came[t, path[t]]
    rank = np.empty(states, np.int64)
    rank[order] = np.arange(states)
    return rank[path]


def states(signal: DataFrame, rounds: int = 100) -> DataFrame:
    """(chrom, resolution, n, bin, state): one chromosome's signal a group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        return pdf[[*KEY, "n", "bin"]].assign(state=fit_states(pdf["x"].to_numpy(), rounds=rounds).astype(np.int32))

    return signal.select(*KEY, "n", "bin", "x").groupBy(*KEY).applyInPandas(run, "chrom string, resolution int, n long, bin long, state int")


def state_domains(c: DataFrame, window: int = 10, least: int = 4, rounds: int = 100) -> DataFrame:
    """Domains by the first of three ways that gives max(5, n div 200) of them: pattern, transitions, sign changes.

    Chromosomes of fewer than 2 * window + 1 bins give nothing.
    """
    directed = S.smooth(S.directionality(c, window), 1.0).filter(F.col("n") >= 2 * window + 1)
    runs = M.islands(states(directed, rounds))
    spine = M.spine_of(directed)
    third = M.crossing_domains(directed, least).select(*KEY, (F.col("start") / F.col("resolution")).cast("long").alias("s"), (F.col("end") / F.col("resolution")).cast("long").alias("e"))
    ways = [M.pattern_domains(runs, least), M.transition_domains(runs, spine, least), third]
    each = None
    for k, w in enumerate(ways):
        part = w.withColumn("way", F.lit(k))
        each = part if each is None else each.unionByName(part)
    counts = each.groupBy(*KEY, "way").agg(F.count(F.lit(1)).alias("_c")).join(spine, KEY)
    enough = counts.filter((F.col("way") == 2) | (F.col("_c") >= F.greatest(F.lit(5), F.expr("n div 200"))))
    chosen = enough.withColumn("_n", F.row_number().over(Window.partitionBy(*KEY).orderBy("way"))).filter("_n = 1").select(*KEY, "way")
    return each.join(chosen, [*KEY, "way"]).select(*KEY, (F.col("s") * F.col("resolution")).alias("start"), (F.col("e") * F.col("resolution")).alias("end"))
