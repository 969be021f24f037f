"""Exact deduplication through content-defined chunk recipes.

A normalised text is cut where a rolling hash of its last 32 bytes has eleven zero bits, so equal passages give equal
chunks wherever they stand.  Chunks are deduplicated to identifiers: a 64-bit hash, which SHA-256 and length verify, and
an ordinal that tells verified chunks with one hash apart.  Texts are equal when their ordered identifier lists are, so
long documents never move: only some 50 bytes for each 2 KB of text do.

Defined results: null text counts as empty, and all empty texts are equal; texts that differ only in runs of white space
are equal; a null doc_id sorts last, so it stays only in a group of nulls; of rows that repeat a doc_id and a text one
is kept; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rallyline.llm.common import ROW, ROW_TYPE, SPACE_CHARS, durable, numbered, settled

#: Bytes of a chunk: at least, at most; a cut needs these bits of the rolling hash to be zero (one place in 2,048).
LEAST, MOST, CUT = 256, 16_384, 0x7FF00000
GEAR = np.random.default_rng(11).integers(0, 2**32, 256, dtype=np.uint32)
_SPACES = tuple(SPACE_CHARS.encode()[i : i + 1] for i in range(len(SPACE_CHARS)))


def normalise(text: bytes | None) -> bytes:
    """Each run of white space as one space, also at the ends."""
    text = text or b""
    words = b" ".join(text.split())
    if not words:
        return b" " if text else b""
    return b" " * text.startswith(_SPACES) + words + b" " * text.endswith(_SPACES)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = GEAR[np.frombuffer(data, np.uint8)]
    for w in (1, 2, 4, 8, 16):  # by doubling: the window's sum of shifted gear values
        h[w:] += h[:-w] << np.uint32(w)
    ends, last = [], 0
    for at in [*(np.flatnonzero((h & np.uint32(CUT)) == 0) + 1).tolist(), n]:
        while at - last > MOST:
            ends.append(last := last + MOST)
        if at - last >= LEAST or at == n and at > last:
            ends.append(last := at)
    return ends


def recipes(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows (row, doc_id, text_sha256, n_bytes, chunks), chunks an array of (short, sha, size) in the text's order."""
    chunk = pa.struct([("short", pa.int64()), ("sha", pa.binary()), ("size", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, sizes, lists = [], [], []
            for text in batch.column(2):
                data = normalise(text.as_py())
                made, start = [], 0
                for end in cuts(data):
                    part = data[start:end]
                    short = xxhash.xxh64_intdigest(part) - 2**63
                    made.append({"short": short, "sha": hashlib.sha256(part).digest(), "size": end - start})
                    start = end
                whole.append(hashlib.sha256(data).hexdigest())
                sizes.append(len(data))
                lists.append(made)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(whole), pa.array(sizes, pa.int64()), pa.array(lists, pa.list_(chunk))],
                ["row", "doc_id", "text_sha256", "n_bytes", "chunks"],
            )

    rows = numbered(docs).select(
        F.col(ROW).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")
    )
    shape = f"row {ROW_TYPE}, doc_id long, text_sha256 string, n_bytes long, chunks array<struct<short: long, sha: binary, size: int>>"
    return rows.mapInArrow(run, shape)


def verified_recipes(made: DataFrame) -> DataFrame:
    """Rows (row, recipe): each row's ordered list of verified chunk identifiers, as an array of (short, ordinal)."""
    parts = made.select("row", F.posexplode("chunks").alias("pos", "c")).select("row", "pos", "c.*")
    distinct = parts.select("short", "sha", "size").distinct()
    # a hash's distinct chunks are one, or a few that collide
    known = durable(
        distinct.withColumn("ordinal", F.row_number().over(Window.partitionBy("short").orderBy("sha", "size")))
    )
    named = parts.join(known, ["short", "sha", "size"])
    lists = named.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "short", "ordinal"))).alias("recipe"))
    return lists.select("row", F.expr("transform(recipe, c -> struct(c.short, c.ordinal))").alias("recipe"))


def grouped(docs: DataFrame) -> DataFrame:
    """One row per row of docs: row, doc_id, keep_id, group_size, kept, text_sha256, n_bytes."""
    made = durable(recipes(docs))
    rows = made.select("row", "doc_id", "text_sha256", "n_bytes")
    listed = durable(rows.join(verified_recipes(made), "row", "left"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))
    groups = listed.groupBy("recipe").agg(F.min(order).alias("stays"), F.count("*").alias("group_size"))
    # written, so that both sides of the join are dealt afresh and a hot recipe can be split
    many = durable(groups.where("group_size > 1")).withColumnRenamed("recipe", "same")
    joined = listed.join(many, F.col("recipe").eqNullSafe(F.col("same")), "left")
    return joined.select(
        "row",
        "doc_id",
        F.when(F.col("stays").isNull(), F.col("doc_id")).otherwise(F.col("stays.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("stays.row") == F.col("row"), F.lit(True)).alias("kept"),
        "text_sha256",
        "n_bytes",
    )


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_bytes."""
    return grouped(settled(docs)).drop("row")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs whose text is the first of its group; only these rows' keys meet the texts, which move once."""
    docs = settled(docs)
    kept = grouped(docs).where("kept").select(F.col("row").alias(ROW))
    return numbered(docs).join(kept.hint("merge"), ROW, "left_semi").select(docs.columns)
