"""Contacts, domains, peaks and sizes read out of an event table: event types are chromosomes, time is the axis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Seconds of a contact bin, and its width on the axis; width of a bin of domains; grid of their ends; length of a peak; seconds of a day.
CONTACT_SECONDS, CONTACT_RES, DOMAIN_RES, GRID, PEAK, DAY = 21600, 25000, 3600, 900, 900, 86400


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chrom, user_id, event_id, t): t in seconds from the first day's start, whatever the session's time zone."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").filter("ts is not null")
    rows = raw.select(F.col("event_type").alias("chrom"), "user_id", "event_id", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("_t"))
    first = rows.agg(F.floor(F.min("_t") / 86400).cast("long") * 86400).scalar()
    return rows.select("chrom", "user_id", "event_id", (F.col("_t") - first).alias("t"))


def contacts(ev: DataFrame) -> DataFrame:
    """Bins that a user's events of one type fall into are in contact; users add up."""
    seen = ev.select("chrom", "user_id", F.floor(F.col("t") / CONTACT_SECONDS).alias("b")).distinct()
    a, b = seen.withColumnRenamed("b", "i"), seen.withColumnRenamed("b", "j")
    pairs = a.join(b, ["chrom", "user_id"]).filter("i <= j")
    return pairs.groupBy("chrom", "i", "j").agg(F.count(F.lit(1)).cast("double").alias("count")).select("chrom", F.lit(CONTACT_RES).alias("resolution"), (F.col("i") * CONTACT_RES).alias("bin_i"), (F.col("j") * CONTACT_RES).alias("bin_j"), "count")


def sessions(ev: DataFrame, factor: int) -> DataFrame:
    """(algorithm, chrom, start, end): events whose gaps are at most ``factor`` mean gaps, snapped outward to the grid. ``ev`` has ``algorithm``.

    Events of one second are one moment, and each day of a key is cut for itself, after a row that carries the last moment before it;
    so a task's window holds a day's seconds, whatever the number of events. Only what reaches over a day's edge, two pieces a day, is then merged along a key.
    """
    key = ["algorithm", "chrom"]
    timed = ev.select(*key, F.floor(F.col("t") / DAY).alias("day"), "t")
    whole = Window.partitionBy(*key)
    days = timed.groupBy(*key, "day").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count(F.lit(1)).alias("n"))
    before = days.select(*key, "day", F.lag("last").over(whole.orderBy("day")).alias("t"), F.sum("n").over(whole).alias("n"), (F.max("last").over(whole) - F.min("first").over(whole)).alias("span"))
    own = Window.partitionBy(*key, "day")
    along = own.orderBy(F.asc_nulls_first("t"), F.desc_nulls_last("span"))
    gap = F.col("t") - F.lag("t").over(along)
    rows = before.unionByName(timed.distinct(), allowMissingColumns=True)
    marked = rows.withColumn("_new", F.when(gap * F.max("n").over(own) > factor * F.max("span").over(own), 1).otherwise(0))
    numbered = marked.withColumn("_piece", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0))).filter("span is null")
    pieces = numbered.groupBy(*key, "day", "_piece").agg(F.min("t").alias("from"), F.max("t").alias("to"), F.max("_new").alias("_new"))
    edged = pieces.withColumn("_edge", (F.col("_new") == 0) | (F.col("_piece") == F.max("_piece").over(own)))
    joined = edged.filter("_edge").withColumn("_session", F.sum("_new").over(whole.orderBy("from").rowsBetween(Window.unboundedPreceding, 0)))
    joined = joined.groupBy(*key, "_session").agg(F.min("from").alias("from"), F.max("to").alias("to"))
    found = edged.filter("not _edge").select(*key, "from", "to").unionByName(joined.select(*key, "from", "to"))
    return found.select(*key, (F.floor(F.col("from") / GRID) * GRID).cast("long").alias("start"), ((F.floor(F.col("to") / GRID) + 1) * GRID).cast("long").alias("end"))


def domains(ev: DataFrame, factor: int = 2) -> DataFrame:
    """Sessions of seven groups of users stand for seven algorithms."""
    own = ev.withColumn("algorithm", F.concat(F.lit("a"), (F.col("user_id") % 7).cast("string")))
    return sessions(own, factor).select("algorithm", "chrom", F.lit(DOMAIN_RES).alias("resolution"), "start", "end")


def reference(ev: DataFrame, factor: int = 2) -> DataFrame:
    own = ev.filter(F.col("user_id") % 11 == 3).withColumn("algorithm", F.lit("ref"))
    return sessions(own, factor).select("chrom", F.lit(DOMAIN_RES).alias("resolution"), "start", "end")


def peaks(ev: DataFrame) -> DataFrame:
    return ev.select(F.col("event_id").alias("peak_id"), "chrom", F.col("t").alias("start"), (F.col("t") + PEAK).alias("end"))


def sizes(ev: DataFrame) -> DataFrame:
    return ev.groupBy("chrom").agg(((F.floor(F.max("t") / DOMAIN_RES) + 1) * DOMAIN_RES).cast("long").alias("size"))


def hierarchy(ev: DataFrame) -> DataFrame:
    """(algorithm, chrom, start_bin, end_bin, depth): sessions by ever smaller gaps lie inside one another."""
    out = None
    for depth, factor in ((1, 4), (2, 2), (3, 1)):
        part = domains(ev, factor).select("algorithm", "chrom", F.floor(F.col("start") / GRID).cast("int").alias("start_bin"), F.floor(F.col("end") / GRID).cast("int").alias("end_bin"), F.lit(depth).alias("depth"))
        out = part if out is None else out.unionByName(part)
    return out
