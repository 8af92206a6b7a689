"""Column functions used throughout."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def with_chr(chrom: Column) -> Column:
    """Every value with the prefix, row by row."""
    return F.when(chrom.startswith("chr"), chrom).otherwise(F.concat(F.lit("chr"), chrom))


def without_chr(chrom: Column) -> Column:
    return F.replace(chrom, F.lit("chr"), F.lit(""))


def to_bin(pos: Column, resolution: Column | int) -> Column:
    return F.floor(pos / (resolution if isinstance(resolution, Column) else F.lit(resolution))).cast("long")


def snap(pos: Column, resolution: Column | int) -> Column:
    """The nearest bin edge, halves to the even one."""
    r = resolution if isinstance(resolution, Column) else F.lit(resolution)
    return F.rint(pos / r).cast("long") * r


def clean(x: Column) -> Column:
    """NaN and infinities as zero."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def clip(x: Column, lo: Column | int, hi: Column | int) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.least(F.greatest(x, as_col(lo)), as_col(hi))


def midpoint(start: Column, end: Column) -> Column:
    return F.floor((start + end) / 2).cast("long")


def log_positive(x: Column) -> Column:
    return F.when(x > 0, F.log1p(x))


def consensus_color(support: Column, saturate: bool = False) -> Column:
    """Colour by support; more support than there are colours has none, or with ``saturate`` the last."""
    from ..schema import CONSENSUS_COLORS

    top = max(CONSENSUS_COLORS)
    of = F.least(support, F.lit(top)) if saturate else support
    out = F.lit("")
    for n, color in CONSENSUS_COLORS.items():
        out = F.when(of == n, color).otherwise(out)
    return out


def upper_tail(z: Column) -> Column:
    """1 - Phi(z) of a standard normal; there is no error function in SQL."""

    def tail(v: pd.Series) -> pd.Series:
        return v.map(lambda x: 0.5 * math.erfc(x / math.sqrt(2)) if pd.notna(x) else None).astype("float64")

    return F.pandas_udf(tail, "double")(z)
