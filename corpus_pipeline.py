"""The corpus pipeline: toxic documents out, one of each group of near copies, repeated passages out, sources mixed, sequences packed.

Each stage takes the documents that the one before it kept, is written as Parquet and read again.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siteworks.llm.common import store, table
from siteworks.llm.jaccard_join import keep_one_each
from siteworks.llm.mixing import take_mix
from siteworks.llm.packing import pack_documents
from siteworks.llm.suffix_dedup import drop_passages
from siteworks.llm.toxicity import keep_clean


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; labels of held-out documents are not used."""
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group that links: sets of five-word shingles with 0.8 or more of their union in common."""
    return keep_one_each(docs, shingle=5, percent=80)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of over 50 words (204 bytes or more) that stand anywhere else too; a cut character goes whole."""
    return drop_passages(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as the mix of sources takes them."""
    return take_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of a document lies in the packed sequences."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("shingle_join", drop_near_copies),
    ("suffix_dedup", drop_repeated_passages),
    ("mixing", mix),
    ("packing", pack),
]

#: Scores, links and token ids can't be expressed in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
