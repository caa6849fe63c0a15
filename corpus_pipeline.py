"""From raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of documents. Stages take nulls in any column, empty and very long texts,
ties, repeated rows, empty tables and further columns; what each does with them is
said below and where its operator is defined. Further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cliptide.llm._common import Scratch, table
from cliptide.llm.mixing import repeat_mixed
from cliptide.llm.near_dedup import keep_one
from cliptide.llm.packing import pack
from cliptide.llm.quality import keep_good
from cliptide.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. Null and empty texts score as an empty window and stay; ids play no part in a score."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, null, empty and blank texts among them. Null languages and sources are groups of their own."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one of the least id (null last). Rows without words, were there any, would all stay."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows come as often as the mix takes them, up to three times. Null sources are one source; a row without words is never taken."""
    return repeat_mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places instead of documents. A repeated row is packed as often as it is there; a null id is carried along."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: A trained network, robust estimates and a linear program: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each on what the one before wrote."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return docs
