"""Registry of domain callers: name -> caller(binned contacts, chromosome sizes, config) -> (chrom, resolution, start, end)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..operators import hierarchy, minima, multiscale, segment, signals, spectral, states
from ..schema import KEY
from ..sources import files
from .config import Config

Caller = Callable[[DataFrame, DataFrame, Config], DataFrame]
CALLERS: dict[str, Caller] = {}


def register(name: str) -> Callable[[Caller], Caller]:
    """Add a caller, one's own included, under a name."""

    def add(caller: Caller) -> Caller:
        CALLERS[name] = caller
        return caller

    return add


def normalised(result, chrom: str, resolution: int) -> pd.DataFrame:
    """(chrom, resolution, start, end) out of what an external caller gives: a frame with start and end (and maybe chrom), pairs, or an array of two columns.

    Rows that do not end after they start go; None, and what has no two columns, gives no rows.
    """
    columns = ["chrom", "resolution", "start", "end"]
    if isinstance(result, pd.DataFrame):
        out = result[["start", "end"]].copy()
        out["chrom"] = result["chrom"] if "chrom" in result else chrom
    else:
        pairs = np.asarray([] if result is None else result)
        out = pd.DataFrame(pairs[:, :2] if pairs.ndim == 2 and pairs.shape[1] >= 2 else np.zeros((0, 2)), columns=["start", "end"])
        out["chrom"] = chrom
    out["resolution"] = resolution
    out = out.dropna(subset=["start", "end"]).astype({"start": "int64", "end": "int64"})
    return out[out["end"] > out["start"]][columns].reset_index(drop=True)


def register_matrix(name: str) -> Callable:
    """Add a caller that takes one chromosome's dense, symmetric matrix and the resolution; its result is normalised. A matrix is one task's: limit the chromosomes."""

    def add(call):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            res = int(pdf["resolution"].iloc[0])
            matrix = spectral.dense(pdf["i"].to_numpy(), pdf["j"].to_numpy(), pdf["v"].to_numpy(), int(pdf["n"].iloc[0]))
            return normalised(call(matrix, res), pdf["chrom"].iloc[0], res)

        register(name)(lambda c, sizes, cfg: c.join(signals.n_bins(c), KEY).select(*KEY, "n", "i", "j", "v").groupBy(*KEY).applyInPandas(run, schema.CALLED))
        return call

    return add


def _per_resolution(c: DataFrame, cfg: Config, call) -> DataFrame:
    """Parameters that depend on the bin width: one plan for each configured resolution."""
    out = None
    for r in cfg.resolutions:
        part = call(c.filter(F.col("resolution") == r), r)
        out = part if out is None else out.unionByName(part)
    return out


@register("armatus")
def _multiscale(c, sizes, cfg):
    return multiscale.multiscale_domains(c, sizes, list(cfg.gammas), cfg.least_windows)


@register("topdom")
def _block_contrast(c, sizes, cfg):
    return minima.block_contrast_domains(c, cfg.windows)


@register("scktld")
def _spectral(c, sizes, cfg):
    return spectral.spectral_domains(c, cfg.dimensions, cfg.min_tad_kb)


@register("coitad")
def _insulation(c, sizes, cfg):
    return _per_resolution(c, cfg, lambda own, r: minima.insulation_domains(own, cfg.insulation_window or max(5, 125_000 // r), cfg.sigma, cfg.prominence, max(3, cfg.min_tad_kb * 1000 // r)))


@register("dihmm")
def _states(c, sizes, cfg):
    return _per_resolution(c, cfg, lambda own, r: states.state_domains(own, cfg.di_window, max(1, cfg.min_tad_kb * 1000 // r), cfg.hmm_rounds))


@register("ontad")
def _flanks(c, sizes, cfg):
    """Domains out of an external caller's hierarchies, where ``cfg.hierarchies`` names them; minima of flank means for all other chromosomes."""
    plain = minima.flank_domains(c, cfg.min_bins)
    if not cfg.hierarchies:
        return plain
    rows = files.read_hierarchy_tree(c.sparkSession, cfg.hierarchies)
    return hierarchy.swept_domains(rows, signals.n_bins(c), cfg.min_bins, cfg.min_tad_kb, plain)


@register("modularity_tad")
def _flank_contrast(c, sizes, cfg):
    return _per_resolution(c, cfg, lambda own, r: segment.flank_contrast_domains(own, max(1, cfg.min_tad_kb * 1000 // r), max(2, cfg.max_tad_kb * 1000 // r), int(cfg.max_distance_mb * 1e6 // r), cfg.penalty))


def eligible(df: DataFrame, limits: dict[int, list[str]] | None) -> DataFrame:
    """Rows of allowed (resolution, chromosome) pairs; a resolution without a list allows all."""
    if not limits:
        return df
    allowed = df.sparkSession.createDataFrame([(int(r), c) for r, cs in limits.items() for c in cs or [None]], "resolution int, chrom string")
    limited = [int(r) for r, cs in limits.items() if cs]
    free = df.filter(~F.col("resolution").isin(limited)) if limited else df
    return free.unionByName(df.filter(F.col("resolution").isin(limited)).join(F.broadcast(allowed.filter("chrom is not null")), KEY, "left_semi")) if limited else df


def detect(contacts: DataFrame, sizes: DataFrame, cfg: Config) -> DataFrame:
    """Domains of all configured callers, one under the other: algorithm is a column, not a loop over results."""
    if unknown := [a for a in cfg.algorithms if a not in CALLERS]:
        raise ValueError(f"unknown algorithms: {', '.join(unknown)}")
    own = contacts.filter(F.col("resolution").isin(*cfg.resolutions))
    if cfg.chromosomes:
        own = own.filter(F.col("chrom").isin(*cfg.chromosomes))
    binned, out = signals.binned(own), None
    for name in cfg.algorithms:
        found = CALLERS[name](eligible(binned, cfg.limits.get(name)), sizes, cfg)
        part = found.filter("end > start").select(F.lit(name).alias("algorithm"), *KEY, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
        out = part if out is None else out.unionByName(part)
    return out
