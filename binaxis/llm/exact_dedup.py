"""Exact dedup by two-pass Bloom filtering, on DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import Bloom
from .common import cut, documents, join_groups, whole_row

#: White space runs that are not one space already.
RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Each run of white space made one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), RUNS, " ")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def exact_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs``.

    Texts are equal when their white space runs, each made one space, leave the same text; its
    SHA-256 stands for it. First pass: a Bloom filter of the slots that at least two rows hit.
    Second pass: only rows whose slots are all in it shuffle to be grouped; the rest pass straight
    through as groups of one. A group of any size is counted by partial sums, and its rows learn of it without
    meeting in one task. A larger input than the filter is made for (about 30 million rows) lets more rows shuffle and
    changes no result: about a tenth of the unrepeated ones at 100 million rows, most at a thousand million.

    A null or empty text counts as empty; a text of any length is read whole. Rows that repeat one doc_id and text each count in
    group_size; all rows whose doc_id is the smallest are kept. Null doc_ids give way to any other; a group of
    only null doc_ids has keep_id null and all its rows kept. An empty table gives no rows. Other columns, of any name, are not read.
    """
    keyed = cut(documents(docs).select("doc_id", digest(F.col("text")).alias("digest")), "exact-keys")
    rows = keyed.count()
    repeated = Bloom(keyed, "digest", 2, rows)
    flagged = cut(keyed.withColumn("maybe", repeated.may_hold(F.col("digest"))), "exact-flagged")
    shown = F.lower(F.hex("digest")).alias("text_sha256")
    alone = flagged.filter("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), shown)
    together = flagged.filter("maybe").select("doc_id", "digest")
    groups = cut(together.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "exact-groups")
    found = join_groups(together, groups, "digest", "group_size", rows).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), shown)
    return alone.unionByName(found)


def drop_exact(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, with all its columns: that of the smallest doc_id.

    The same two passes: rows whose text is surely unrepeated pass straight through; of the others each task keeps the first
    row of a group before any shuffle, so a text with any number of copies shuffles once a task.

    A null doc_id comes after all others. Of rows equal in doc_id, that of the least text stays, and of rows equal in both
    that of the least other columns; so of a row that repeats, one. A null or empty text counts as empty. An empty table gives no rows. Extra columns may have any name.
    """
    keys = cut(docs.select(digest(docs["text"].cast("string")).alias("digest")), "exact-keys")
    repeated = Bloom(keys, "digest", 2, keys.count())
    row, others = whole_row(docs)
    order = F.struct(docs["doc_id"].isNull(), docs["doc_id"], docs["text"], others)
    flagged = docs.select(digest(docs["text"].cast("string")).alias("digest"), order.alias("order"), row.alias("row"))
    flagged = flagged.withColumn("maybe", repeated.may_hold(F.col("digest")))
    alone = flagged.filter("not maybe").select("row.*")
    together = flagged.filter("maybe").groupBy("digest").agg(F.min_by("row", "order").alias("row")).select("row.*")
    return alone.union(together)
