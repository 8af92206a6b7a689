"""Contacts of files that only a library reads, as a Spark data source: one partition for each chromosome and resolution.

    spark.dataSource.register(plug.ContactSource)
    spark.read.format("contact-file").option("path", p).option("chroms", "chr1,chr2").option("resolutions", "25000").load()

The option ``reader`` names a module that is installed on all hosts and has ``records(path, chrom, resolution, normalization)``, which gives (bin_i, bin_j, count) in bp.
Without it the public package ``hicstraw`` is used for binary contact maps, if it is installed.
"""

from __future__ import annotations

from collections.abc import Iterator
from importlib import import_module

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import schema


def straw_records(path: str, chrom: str, resolution: int, normalization: str) -> Iterator[tuple[int, int, float]]:
    """Records of a binary contact map by ``hicstraw``; chromosomes are named there with or without their prefix."""
    import hicstraw

    file = hicstraw.HiCFile(path)
    names = {c.name for c in file.getChromosomes()}
    name = next((n for n in (chrom, chrom.removeprefix("chr")) if n in names), None)
    if name is None:
        raise ValueError(f"{chrom} is not in {path}")
    for r in file.getMatrixZoomData(name, name, "observed", normalization, "BP", resolution).getRecords():
        yield r.binX, r.binY, r.counts


class Part(InputPartition):
    def __init__(self, chrom: str, resolution: int):
        self.chrom, self.resolution = chrom, resolution


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.module = options["path"], options.get("reader")
        self.chroms = [c.strip() for c in options["chroms"].split(",")]
        self.resolutions = [int(r) for r in options["resolutions"].split(",")]
        self.normalization = options.get("normalization", "NONE")

    def partitions(self):
        return [Part(c, r) for c in self.chroms for r in self.resolutions]

    def read(self, partition):
        records = import_module(self.module).records if self.module else straw_records
        for i, j, count in records(self.path, partition.chrom, partition.resolution, self.normalization):
            yield partition.chrom, partition.resolution, int(min(i, j)), int(max(i, j)), float(count)


class ContactSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "contact-file"

    def schema(self) -> str:
        return schema.CONTACTS

    def reader(self, schema):
        return _Reader(self.options)
