"""Helpers that the text operators share: reading tables, checkpoints, ASCII text rules, connected components."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyline.session import checkpoint_dir, durable

__all__ = ["ROW", "ROW_TYPE", "ascii_lower", "components", "durable", "give_back", "numbered", "scanned", "settled", "stored", "table"]

#: The name of a row's key among a table's own columns, and its type.
ROW, ROW_TYPE = "_rl_row", "struct<file: long, at: long>"
#: The white space of every contract, U+0020 and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table of their own in the run's part of the shared folder, for whole documents or many rows."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def scanned(docs: DataFrame) -> bool:
    """Whether docs is a file scan that is at most filtered and mapped, always alike: then its rows can be read again."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias") and plan.deterministic():
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation"


def settled(docs: DataFrame) -> DataFrame:
    """docs where each of its rows is one row of a Parquet file, else a stored copy of docs, of which that is true."""
    if scanned(docs):
        try:
            docs.select(docs.metadataColumn("_metadata")["row_index"])
        except AnalysisException:  # a format that doesn't number its rows
            return stored(docs)
        return docs
    return stored(docs)


def numbered(docs: DataFrame) -> DataFrame:
    """docs, which must be settled, with ROW: the file that a row lies in, by a hash of its path, and its place there.

    This names a row however the scan is cut into tasks, which depends on the executors that are there when it is planned.
    """
    where = docs.metadataColumn("_metadata")
    return docs.withColumn(ROW, F.struct(F.xxhash64(where["file_path"]).alias("file"), where["row_index"].alias("at")))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else: lower() agrees on pure ASCII, and translate() serves the rest."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def give_back() -> None:
    """Give memory that a task has freed back to the system: its Python worker lives on, and other stages need it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the edges (u, v), two longs each: rows (node, root), where root is the least node.

    Alternating large-star and small-star steps, each of partial minima and joins that adaptive execution can split,
    so no neighbourhood is gathered.  Only a count and a hash come to the driver in each round.  A root has no row.
    """
    edges = durable(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    before = signature(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = (
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        edges = durable(small)
        after = signature(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
