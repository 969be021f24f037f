"""The corpus pipeline: documents to packed windows, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.  All but the last return the columns
of documents, with whole rows; the last returns one row for each packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rallyline.llm import mixing, packing, perplexity, recipes, simhash
from rallyline.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model finds no worse than trusted text of their language (operator 6)."""
    return perplexity.keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each normalised text (operator 2)."""
    return recipes.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles have a similarity of 0.8 or more (operator 1)."""
    return simhash.near_dedup(docs, width=5, similarity=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents in the copies that their sources' target weights ask for (operator 9)."""
    return mixing.mixture(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in windows of 4,096 tokens (operator 4)."""
    return packing.packed(docs, end_id=2, capacity=4096)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("simhash near-dedup", near),
    ("source mixing", mix),
    ("packing", pack),
]

#: A language model's perplexity and the packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
