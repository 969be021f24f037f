"""Line deduplication across documents, with DataFrame functions alone.

Every line is exploded to two 64-bit hashes of its key (stripped, A-Z lower-cased); a hash's least and greatest doc_id
tell whether at least two documents hold it, in one aggregate that combines before the shuffle.  Lines over the
threshold go from all documents but the one with the smallest doc_id, and the rest is put together by position.  Only
hashes move by key; a text moves once, to meet its own line flags.

Defined results: null or empty text is one empty line; keys shorter than `least` code points always stay; repeats in
the document that keeps a line stay; rows that repeat a doc_id are one document, a null doc_id is one document that
sorts last; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyline.llm.common import SPACE_CHARS, ascii_lower, durable

#: What stands for a null doc_id in comparisons.
LAST = 2**63 - 1


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(SPACE_CHARS)))


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"),
        F.xxhash64(text).alias("t"),
        text.alias("text"),
    )


def line_hashes(docs: DataFrame, least: int = 10) -> DataFrame:
    """Rows (d, t, pos, h, g) for every line whose key has at least `least` code points; d, t stand for the document."""
    lines = _rows(docs).select("d", "t", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = lines.select("d", "t", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= least)
    return keyed.select("d", "t", "pos", F.xxhash64("key").alias("h"), F.xxhash64(F.lit("line"), "key").alias("g"))


def dropped_positions(docs: DataFrame, least: int = 10) -> DataFrame:
    """Rows (d, t, drops): a document's dropped line positions in order."""
    hashes = durable(line_hashes(docs, least))
    held = hashes.groupBy("h", "g").agg(F.min("d").alias("first"), F.max("d").alias("last"))
    # written, so that both sides of the join are dealt afresh and a hot line can be split
    shared = durable(held.where("first < last").select("h", "g", "first"))
    gone = hashes.join(shared, ["h", "g"]).where("d > first").select("d", "t", "pos")
    return gone.groupBy("d", "t").agg(F.sort_array(F.collect_set("pos")).alias("drops"))


def line_dedup(docs: DataFrame, least: int = 10) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_dropped, kept_text."""
    rows = _rows(docs).join(dropped_positions(docs, least), ["d", "t"], "left")
    rows = rows.select("doc_id", "text", "drops", F.split("text", "\n", -1).alias("lines"))
    # slices between the dropped positions, so that the work is linear in the lines
    kept = """
      CASE WHEN drops IS NULL THEN text ELSE array_join(flatten(transform(
        sequence(0, size(drops)),
        i -> slice(lines,
               IF(i = 0, 1, element_at(drops, i) + 2),
               IF(i = size(drops), size(lines), element_at(drops, i + 1)) - IF(i = 0, 0, element_at(drops, i) + 1)
        ))), '\n') END
    """
    return rows.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("drops").isNull(), 0).otherwise(F.size("drops")).cast("long").alias("n_dropped"),
        F.expr(kept).alias("kept_text"),
    )
