"""Helpers shared by the corpus operators: shared storage, safe column picking, word splitting."""

from __future__ import annotations

import gc
import math
import os
import tempfile
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run without these characters (space, tab, LF, VT, FF, CR).
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see, as a URI without a trailing slash.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and the master is local (tests, a
    laptop) a folder of this machine is used; executors elsewhere would not see it.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that the driver and all executors share in spark.checkpoint.dir")
        named = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    return named.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    release(spark)
    return back


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of jobs whose results were written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def local_fs(uri: str):
    """(file system, path) of a URI for workers that read and write raw files."""
    from pyarrow import fs

    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parsed.path)
    return fs.FileSystem.from_uri(uri)


def documents(df: DataFrame, *more: str) -> DataFrame:
    """Only (doc_id, text, *more), so that extra columns of any name can't clash."""
    return df.select(df["doc_id"].cast("long").alias("doc_id"), df["text"].cast("string").alias("text"), *(df[c] for c in more))


def whole_row(df: DataFrame) -> tuple[Column, Column]:
    """(all columns as one struct, what is in those other than doc_id and text as one string), so that columns of any name can't clash."""
    named = [df[f"`{c.replace('`', '``')}`"] for c in df.columns]
    others = [column for c, column in zip(df.columns, named) if c not in ("doc_id", "text")]
    return F.struct(*named), F.to_json(F.struct(*others)) if others else F.lit("")


def row_key(df: DataFrame) -> Column:
    """128 bits that tell rows that differ in any column apart."""
    shown = [F.coalesce(F.concat(F.lit("="), df[c].cast("string")), F.lit("-")) for c in ("doc_id", "text")]
    return F.unhex(F.md5(F.concat(shown[0], F.lit("\x00"), whole_row(df)[1], F.lit("\x00"), shown[1])))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def n_tasks(spark: SparkSession, rows: int, per_task: int) -> int:
    """Partitions for so many rows: grows with the input, at least the session's parallelism."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / per_task))


#: A group is hot if it holds more than this share of all rows; so there are fewer hot groups than this number.
HOT_SHARE = 1024


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` with the columns of their group in ``groups``, no group in one task.

    ``groups`` has one row a key, with the number of its rows in ``size``; ``total`` is the number of all rows. Hot
    groups, fewer than HOT_SHARE whatever the input, travel to the rows; only rows of the others shuffle.
    """
    is_hot = F.col(size) * HOT_SHARE > total
    hot, cold = F.broadcast(groups.filter(is_hot)), groups.filter(~is_hot)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))
