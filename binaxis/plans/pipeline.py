"""A whole run: contacts to domains, consensus, statistics, enrichment and report. Also the command line."""

from __future__ import annotations

import argparse
import logging
import sys
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators import boundaries as B
from ..operators import compare, enrichment
from ..sources import files
from . import render
from .callers import CALLERS, detect
from .config import Config, load

log = logging.getLogger("binaxis")


@dataclass
class Run:
    domains: DataFrame
    consensus: DataFrame
    statistics: dict[str, DataFrame]
    validation: DataFrame | None


def hg19_sizes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(schema.HG19.items()), "chrom string, size long")


def run(contacts: DataFrame, cfg: Config, peaks: DataFrame | None = None, reference: DataFrame | None = None, sizes: DataFrame | None = None, skip_statistics: bool = False, skip_validation: bool = False) -> Run:
    """Lazy plans over one table of domains, which is kept for them all."""
    sizes = hg19_sizes(contacts.sparkSession) if sizes is None else sizes
    domains = detect(contacts, sizes, cfg).persist()
    found = B.consensus(domains, cfg.tolerance_bins, cfg.min_support, least_algorithms=2)
    statistics = {} if skip_statistics else compare.aggregate_statistics(domains, sizes, found, reference)
    valid = None
    if peaks is not None and not skip_validation:
        width = 2 * cfg.window_bins * max(cfg.resolutions)
        valid = enrichment.validation(domains, found, peaks, sizes, width, cfg.permutations, window_bins=cfg.window_bins)
    return Run(domains, found, statistics, valid)


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="binaxis")
    p.add_argument("--config", help="YAML file of parameters")
    p.add_argument("--contacts", required=True, help="table of contacts, or a glob of triple files")
    p.add_argument("--out", required=True)
    p.add_argument("--peaks")
    p.add_argument("--reference")
    p.add_argument("--resolution", type=int, nargs="*")
    p.add_argument("--chroms", nargs="*")
    p.add_argument("--algorithms", nargs="*")
    for flag in ("prep-data", "only-viz", "skip-stats", "skip-validation", "skip-report", "force"):
        p.add_argument(f"--{flag}", action="store_true")
    p.add_argument("--views", nargs="*", metavar="CHROM:FIRST-PAST", help="views to write, in bp")
    p.add_argument("--log-level", default="INFO")
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    args = arguments(argv)
    logging.basicConfig(level=args.log_level)
    cfg = Config.of(load(args.config)) if args.config else Config()
    cfg = replace(cfg, **{k: tuple(v) for k, v in (("resolutions", args.resolution), ("chromosomes", args.chroms), ("algorithms", args.algorithms)) if v})
    if unknown := [a for a in cfg.algorithms if a not in CALLERS]:
        log.error("unknown algorithms: %s", ", ".join(unknown))
        return 1
    spark = SparkSession.builder.appName("binaxis").getOrCreate()
    spans = {c: (int(a), int(b)) for c, _, ab in (v.partition(":") for v in args.views or ()) for a, _, b in [ab.partition("-")]}
    if args.only_viz and not spans:
        log.error("--only-viz needs --views")
        return 1
    contacts = files.first_of(spark, [lambda: files.read_table(spark, args.contacts, schema.CONTACTS), lambda: files.read_triples_tree(spark, args.contacts)])
    if args.prep_data:
        files.prepare(contacts, f"{args.out}/contacts", args.force)
        return 0
    if args.only_viz:  # views of the domains that a run before left
        domains = files.read_domains(spark, f"{args.out}/domains")
        render.write_views(render.views(contacts, domains, B.consensus(domains, cfg.tolerance_bins, cfg.min_support, least_algorithms=2), spans), f"{args.out}/views")
        return 0
    peaks = files.read_bed3(spark, args.peaks) if args.peaks else None
    reference = None
    if args.reference:
        reference = files.read_reference(spark, args.reference, cfg.resolutions[0])
        reference = reference.drop("resolution").withColumn("resolution", F.explode(F.array(*map(F.lit, cfg.resolutions))))
    result = run(contacts, cfg, peaks, reference, skip_statistics=args.skip_stats, skip_validation=args.skip_validation)
    files.write_domains(result.domains, f"{args.out}/domains")
    files.write_bed(B.consensus_bed6(result.consensus), f"{args.out}/consensus")
    files.write_tables(result.statistics, f"{args.out}/statistics")
    if result.validation is not None:
        files.write_tables({"validation": result.validation}, f"{args.out}/statistics")
    if spans:
        render.write_views(render.views(contacts, result.domains, result.consensus, spans), f"{args.out}/views")
    if not args.skip_report:
        tables = result.statistics | ({"validation": result.validation} if result.validation is not None else {})
        spark.createDataFrame([(render.report(tables),)], "value string").coalesce(1).write.mode("overwrite").text(f"{args.out}/report")
    return 0


if __name__ == "__main__":
    sys.exit(main())
