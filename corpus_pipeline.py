"""Corpus preparation: toxicity, exact dedup, SimHash near-dedup, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; its result is written as Parquet to the shared
folder and read back. All but the last return the columns of documents, extra columns of any name included. An empty table goes through
all stages as one; a text of any length is read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binaxis.llm import toxicity
from binaxis.llm.common import cut
from binaxis.llm.exact_dedup import drop_exact
from binaxis.llm.mixing import mix_documents
from binaxis.llm.packing import pack
from binaxis.llm.queries import fold, table
from binaxis.llm.simhash import drop_near


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go. Learned from the labels of documents that op4_toxicity learns from too.

    Null and empty texts are scored too, and stay unless the model, without any word, calls them toxic. Rows that repeat stay or go alike.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    return toxicity.drop_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised texts, that of the smallest doc_id stays; a null doc_id comes last, a null text counts as empty, and of rows that repeat one stays."""
    return drop_exact(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near fingerprints, that of the smallest doc_id stays; a null doc_id comes last, and all wordless texts are one group."""
    return drop_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and with the words, that the mix of sources takes them; a null source is a source, a document without words does not come."""
    return mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all packed sequences, with their token ids; rows that repeat a doc_id are packed each for itself, an empty text as its end id."""
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The toxicity model has no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
