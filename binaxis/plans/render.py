"""Tables ready to draw, and the HTML report."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import log_positive
from ..schema import KEY


def heat_cells(contacts: DataFrame, first: int, last: int) -> DataFrame:
    """log1p contacts of a view [first, last) of the axis, with the 5th and 99th percentile as limits of colour."""
    view = contacts.filter((F.col("bin_i") >= first) & (F.col("bin_j") < last)).withColumn("value", log_positive(F.col("count")))
    limits = view.groupBy(*KEY).agg(F.percentile("value", F.lit(0.05)).alias("low"), F.percentile("value", F.lit(0.99)).alias("high"))
    return view.join(limits, KEY).select(*KEY, "bin_i", "bin_j", "value", "low", "high")


def triangles(domains: DataFrame, first: int, last: int) -> DataFrame:
    """Corners in bins of the triangles of domains that lie in a view, counted from its start."""
    shown = domains.filter((F.col("start") >= first) & (F.col("end") <= last))
    a, b = (F.floor((F.col(c) - first) / F.col("resolution")) for c in ("start", "end"))
    return shown.select("algorithm", *KEY, a.alias("i0"), b.alias("i1"), ((a + b) / 2).alias("mid"))


def lines(consensus: DataFrame, first: int, last: int, plain: str = "#999999") -> DataFrame:
    shown = consensus.filter(F.col("position").between(first, last - 1))
    return shown.select(*KEY, F.floor((F.col("position") - first) / F.col("resolution")).alias("bin"), F.when(F.col("color") == "", plain).otherwise(F.col("color")).alias("color"))


def views(contacts: DataFrame, domains: DataFrame, consensus: DataFrame, spans: dict[str, tuple[int, int]]) -> dict[str, DataFrame]:
    """Tables of a comparison of callers, and of the consensus, for a view of each chromosome in ``spans`` (chrom -> first and past bp): cells, triangles, lines."""
    if not spans:
        raise ValueError("no views")
    out: dict[str, DataFrame] = {}
    for chrom, (first, past) in spans.items():
        own = lambda df: df.filter(F.col("chrom") == chrom)  # noqa: B023, E731
        parts = {"cells": heat_cells(own(contacts), first, past), "triangles": triangles(own(domains), first, past), "lines": lines(own(consensus), first, past)}
        for name, df in parts.items():
            df = df.withColumn("first", F.lit(first).cast("long"))
            out[name] = out[name].unionByName(df) if name in out else df
    return out


def write_views(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table of views as Parquet, a folder for each resolution and chromosome."""
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy("resolution", "chrom").parquet(f"{folder}/{name}")


def _cell(x) -> str:
    if x is None or x != x:
        return "—"
    return f"{x:.4f}" if isinstance(x, float) else html.escape(str(x))


def report(tables: dict[str, DataFrame], rows: int = 200) -> str:
    """A page with the first rows of each table."""
    out = ["<!doctype html><meta charset='utf-8'><title>Domain report</title>"]
    for name, df in tables.items():
        shown = df.limit(rows).collect()
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{_cell(x)}</td>" for x in r) + "</tr>" for r in shown)
        out.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{body}</table>")
    return "\n".join(out)
