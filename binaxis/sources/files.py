"""Text and Parquet sources and sinks. Schemas are always given, never inferred."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions.scalar import with_chr


def resolution_label(resolution: int) -> str:
    return f"{resolution // 1000}kb" if resolution % 1000 == 0 else f"{resolution}bp"


# --- contacts ---


def read_triples(spark: SparkSession, path: str, chrom: str, resolution: int, repeats: str = "sum") -> DataFrame:
    """Tab-separated (bin_i, bin_j, count) in bp. ``repeats``: what becomes of a pair given twice, ``sum``, ``max``, or ``last`` (in the order of lines)."""
    raw = spark.read.schema("bin_i bigint, bin_j bigint, count double").option("sep", "\t").csv(path).withColumn("_line", F.monotonically_increasing_id()).filter("bin_i is not null and bin_j is not null")
    lo, hi = F.least("bin_i", "bin_j"), F.greatest("bin_i", "bin_j")
    agg = {"sum": F.sum("count"), "max": F.max("count"), "last": F.max_by("count", "_line")}[repeats]
    return raw.groupBy(lo.alias("bin_i"), hi.alias("bin_j")).agg(agg.alias("count")).select(F.lit(chrom).alias("chrom"), F.lit(resolution).alias("resolution"), "bin_i", "bin_j", "count")


def read_triples_tree(spark: SparkSession, glob: str, pattern: str = r"(chr[0-9A-Za-z]+)_(\d+)(kb|bp)") -> DataFrame:
    """All triple files under a glob; chromosome and resolution come from the file names."""
    raw = spark.read.schema("bin_i bigint, bin_j bigint, count double").option("sep", "\t").csv(glob).withColumn("_file", F.input_file_name())
    unit = F.when(F.regexp_extract("_file", pattern, 3) == "kb", 1000).otherwise(1)
    return raw.select(F.regexp_extract("_file", pattern, 1).alias("chrom"), (F.regexp_extract("_file", pattern, 2).cast("int") * unit).alias("resolution"), "bin_i", "bin_j", "count")


def write_triples(contacts: DataFrame, path: str) -> None:
    contacts.filter("bin_i <= bin_j and count > 0").select("bin_i", "bin_j", "count").write.mode("overwrite").option("sep", "\t").csv(path)


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(r, line): the lines of one file that are not blank, numbered from 0. Splits follow one another, so a line's number is its place in its split after all lines of splits before."""
    lines = spark.read.text(path).filter("trim(value) <> ''").withColumn("_id", F.monotonically_increasing_id())
    lines = lines.select(F.col("value").alias("line"), F.shiftright("_id", 33).alias("_split"), (F.col("_id") % F.lit(1 << 33)).alias("_at"))
    before = Window.orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    base = lines.groupBy("_split").agg(F.count(F.lit(1)).alias("_n")).select("_split", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return lines.join(F.broadcast(base), "_split").select((F.col("_before") + F.col("_at")).alias("r"), "line")


def read_dense(spark: SparkSession, path: str, chrom: str, resolution: int) -> DataFrame:
    """A (gzipped) matrix, one tab-separated row a line; keeps positive cells of the upper triangle, checks the shape. A file that can be split is read in splits."""
    rows = _numbered_lines(spark, path).select("r", F.split(F.trim("line"), r"\s+").alias("cells"))
    shape = rows.agg(F.count(F.lit(1)), F.min(F.size("cells")), F.max(F.size("cells"))).first()
    if not shape[0] == shape[1] == shape[2]:
        raise ValueError(f"{path}: {shape[0]} rows of {shape[1]} to {shape[2]} columns")
    cells = rows.select("r", F.posexplode("cells").alias("k", "v")).select("r", "k", F.expr("try_cast(v as double)").alias("count"))
    return cells.filter("k >= r and count > 0").select(F.lit(chrom).alias("chrom"), F.lit(resolution).alias("resolution"), (F.col("r").cast("long") * resolution).alias("bin_i"), (F.col("k").cast("long") * resolution).alias("bin_j"), "count")


def log_counts(contacts: DataFrame, factors: DataFrame | None = None) -> DataFrame:
    """Natural logarithms of positive counts; with ``factors`` (chrom, bin, k) of counts over both bins' factors, where those are positive."""
    if factors is None:
        return contacts.filter("count > 0").withColumn("count", F.log("count"))
    f = factors.filter("k > 0 and not isnan(k)")
    fi, fj = f.select("chrom", F.col("bin").alias("_i"), F.col("k").alias("_ki")), f.select("chrom", F.col("bin").alias("_j"), F.col("k").alias("_kj"))
    keyed = contacts.filter("count > 0").withColumn("_i", F.expr("bin_i div resolution")).withColumn("_j", F.expr("bin_j div resolution"))
    return keyed.join(fi, ["chrom", "_i"]).join(fj, ["chrom", "_j"]).withColumn("count", F.log(F.col("count") / (F.col("_ki") * F.col("_kj")))).select(*contacts.columns)


def prepare(contacts: DataFrame, path: str, force: bool = False) -> DataFrame:
    """Contacts as a table partitioned by resolution and chromosome; partitions already there stay unless ``force``."""
    spark = contacts.sparkSession
    if not force and (have := read_table(spark, path, schema.CONTACTS)) is not None:
        contacts = contacts.join(have.select("chrom", "resolution").distinct(), ["chrom", "resolution"], "left_anti")
    contacts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("resolution", "chrom").parquet(path)
    return read_table(spark, path, schema.CONTACTS)


def read_table(spark: SparkSession, path: str, ddl: str) -> DataFrame | None:
    try:
        return spark.read.schema(ddl).parquet(path)
    except AnalysisException:
        return None


def read_through(spark: SparkSession, path: str, readers) -> DataFrame:
    """The table of contacts at ``path``; where it is not there yet, the first of ``readers`` that gives one is written there and read back."""
    have = read_table(spark, path, schema.CONTACTS)
    return have if have is not None else prepare(first_of(spark, readers).select(*(c.split()[0] for c in schema.CONTACTS.split(", "))), path)


def first_of(spark: SparkSession, readers) -> DataFrame:
    """The first source that is there: each of ``readers`` gives a frame, None, or fails to find its path."""
    for read in readers:
        try:
            if (df := read()) is not None:
                return df
        except AnalysisException:
            continue
    raise FileNotFoundError("no source of contacts is there")


# --- intervals ---


def read_bed3(spark: SparkSession, path: str) -> DataFrame:
    """First three columns of a BED file, chromosomes with their prefix, each row numbered."""
    raw = spark.read.schema(schema.PEAKS).option("sep", "\t").option("comment", "#").csv(path).filter("start is not null")
    return raw.withColumn("chrom", with_chr(F.col("chrom"))).withColumn("peak_id", F.monotonically_increasing_id())


def read_reference(spark: SparkSession, path: str, resolution: int, chrom: str | None = None) -> DataFrame:
    """First three columns of a table with a header; chromosomes are text and get their prefix row by row."""
    raw = spark.read.option("sep", "\t").option("header", True).csv(path)
    a, b, c = raw.columns[:3]
    out = raw.select(with_chr(F.col(f"`{a}`").cast("string")).alias("chrom"), F.lit(resolution).alias("resolution"), F.expr(f"try_cast(`{b}` as bigint)").alias("start"), F.expr(f"try_cast(`{c}` as bigint)").alias("end"))
    return out if chrom is None else out.filter(F.col("chrom") == chrom)


def write_domains(domains: DataFrame, path: str) -> None:
    domains.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("algorithm", "resolution", "chrom").parquet(path)


def read_domains(spark: SparkSession, path: str) -> DataFrame:
    """The domains written, or none."""
    found = read_table(spark, path, schema.DOMAINS)
    return spark.createDataFrame([], schema.DOMAINS) if found is None else found


def write_bed(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").csv(path)


def read_domains_bed(spark: SparkSession, path: str, algorithm: str, resolution: int) -> DataFrame:
    raw = spark.read.schema(schema.PEAKS).option("sep", "\t").csv(path)
    return raw.select(F.lit(algorithm).alias("algorithm"), "chrom", F.lit(resolution).alias("resolution"), "start", "end")


def read_consensus_bed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.BED6).option("sep", "\t").csv(path).select("chrom", F.col("start").alias("position"), F.col("score").alias("support"))


def _fields(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.trim("value").alias("line")).filter("line <> '' and not startswith(line, '#')")
    return lines.select(F.split("line", r"\s+").alias("f"))


def _field(k: int, kind: str):
    return F.expr(f"try_cast(get(f, {k}) as {kind})")


def read_domain_text(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, end) from lines of three or more fields; lines whose second and third are not whole numbers are skipped."""
    return _fields(spark, path).select(F.col("f")[0].alias("chrom"), _field(1, "bigint").alias("start"), _field(2, "bigint").alias("end")).filter("start is not null and end is not null")


def read_hierarchy_text(spark: SparkSession, path: str) -> DataFrame:
    """Rows of five numeric fields; blank, comment, short and bad lines are skipped."""
    names = [c.split() for c in schema.HIERARCHY.split(", ")]
    rows = _fields(spark, path).select(*(_field(k, kind).alias(name) for k, (name, kind) in enumerate(names)))
    return rows.dropna()


def read_hierarchy_tree(spark: SparkSession, glob: str, pattern: str = r"(chr[0-9A-Za-z]+)_(\d+)(kb|bp)_p([0-9.]*[0-9])") -> DataFrame:
    """(chrom, resolution, penalty, HIERARCHY) of all files under a glob; chromosome, resolution and penalty come from the file names."""
    lines = spark.read.text(glob).select(F.trim("value").alias("line"), F.input_file_name().alias("_file")).filter("line <> '' and not startswith(line, '#')")
    part = lambda k: F.regexp_extract("_file", pattern, k)
    unit = F.when(part(3) == "kb", 1000).otherwise(1)
    named = lines.select(part(1).alias("chrom"), (part(2).cast("int") * unit).alias("resolution"), part(4).try_cast("double").alias("penalty"), F.split("line", r"\s+").alias("f"))
    names = [c.split() for c in schema.HIERARCHY.split(", ")]
    return named.select("chrom", "resolution", "penalty", *(_field(k, kind).alias(name) for k, (name, kind) in enumerate(names))).dropna()


def inclusive_text(domains: DataFrame) -> DataFrame:
    """chrom, start, last bp: the text form in which ends are included."""
    return domains.select("chrom", "start", (F.col("end") - 1).alias("end"))


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as CSV with a header, under its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
