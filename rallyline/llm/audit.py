"""Filter interaction audit by Walsh-Hadamard sums.

Every document gets a mask of the filters that it fails.  For each part and label (all documents, good ones, toxic ones)
the masks are aggregated into 32 signed parity sums: sum number w adds a document with the sign of the parity of
mask & w.  The Walsh-Hadamard transform of the sums, divided by 32, gives back exactly how many documents have each
mask; orders, steps, overlaps and Shapley values are then arithmetic on 32 cells of a part, whatever its size.

A document that fails j filters is removed by each of them in 120 / j of the 120 orders, which is the closed form of a
filter's Shapley value times 120.

Defined results: null text counts as empty; null lang is the part of the empty string; an empty table has no parts and
gives no rows.  Rows that repeat a doc_id are documents each; of rows with one text and one doc_id none is the smaller,
so none fails E for the other's sake; a row without a doc_id never fails E, makes none fail it, and has no label.  A doc_id
is good or toxic if any of its rows of labels says so.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyline.llm.common import WORD_CLASS, durable

#: The filters in the order of their bits.
FILTERS = "ABCDE"
CELLS = 1 << len(FILTERS)
#: Fixed values of the filters: words at least; distinct words of 100 at least; capitals of 100 code points at most.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
SYMBOLS = r"[#$%&*|]"
CLASSES = ("every", "good", "toxic")


def bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def own_failures(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, part, digest, mask), the mask of filters A to D, which look at a text alone."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD_CLASS), F.lit(0)))
    n = F.size("words")
    fails = {
        "A": n < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct("words")) < LEAST_DISTINCT * n,
        "C": 100 * F.regexp_count("text", F.lit("[A-Z]")) > MOST_CAPITALS * F.char_length("text"),
        "D": F.col("text").rlike(SYMBOLS),
    }
    mask = sum((F.when(f, bit(k)).otherwise(0) for k, f in fails.items()), F.lit(0))
    return rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))


def failures(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, part, mask), one per row of docs: the mask of all filters that it fails.

    Equal texts meet by SHA-256, so no text moves; only digests of several rows are joined, and a hot one can be split.
    """
    rows = durable(own_failures(docs))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    rows = rows.join(durable(first).select("digest", "first").hint("merge"), "digest", "left")
    repeats = F.when(F.col("first") < F.col("doc_id"), bit("E")).otherwise(0)
    return rows.select("doc_id", "part", F.col("mask").bitwiseOR(repeats).alias("mask"))


def classed(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (part, mask, class): each document once for every class it belongs to."""
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = masks.join(durable(known).hint("merge"), "doc_id", "left")
    classes = F.array(F.lit("every"), F.when(F.col("good"), "good"), F.when(F.col("toxic"), "toxic"))
    return rows.select("part", "mask", F.explode(F.array_compact(classes)).alias("class"))


def parity_sums(rows: DataFrame) -> DataFrame:
    """Rows (part, class, sums): 32 signed parity sums, each a partial aggregate before the shuffle."""
    signed = [F.sum(F.lit(1) - 2 * (F.bit_count(F.col("mask").bitwiseAND(w)) % 2)).cast("long") for w in range(CELLS)]
    return rows.groupBy("part", "class").agg(F.array(*signed).alias("sums"))


def inverted(sums: DataFrame) -> DataFrame:
    """Rows (part, class, cells): how many documents have each mask; the transform is its own inverse but for a factor 32."""
    every = f"sequence(0, {CELLS - 1})"
    cell = f"aggregate({every}, 0L, (s, w) -> s + (1 - 2 * (bit_count(m & w) % 2)) * sums[w]) DIV {CELLS}"
    return sums.select("part", "class", F.expr(f"transform({every}, m -> {cell})").alias("cells"))


def stepped(parts: DataFrame) -> DataFrame:
    """Each row once for every step of every order: filter_order, step, own (the step's bit), before (the mask of earlier ones)."""
    rows = parts.withColumn("filter_order", F.explode(F.lit(["".join(names) for names in permutations(FILTERS)])))
    rows = rows.withColumn("step", F.explode(F.lit(list(range(1, len(FILTERS) + 1)))))
    bits = f"transform(split(filter_order, ''), x -> shiftleft(1, locate(x, '{FILTERS}') - 1))"
    rows = rows.withColumn("bits", F.expr(bits)).withColumn("own", F.get("bits", F.col("step") - 1))
    return rows.withColumn("before", F.expr("aggregate(slice(bits, 1, step - 1), 0, (s, x) -> s | x)"))


def over(cells: str, value: str) -> Column:
    """The sum over the masks m of cells[m] * value, value an expression of m."""
    return F.expr(f"aggregate(sequence(0, {CELLS - 1}), 0L, (s, m) -> s + {cells}[m] * {value})")


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    cells = inverted(parity_sums(classed(failures(docs), labels)))
    none = F.array_repeat(F.lit(0).cast("long"), CELLS)
    of = [F.coalesce(F.first(F.when(F.col("class") == c, F.col("cells")), ignorenulls=True), none).alias(c) for c in CLASSES]
    parts = durable(cells.groupBy("part").agg(*of))
    rows = stepped(parts)
    here = "IF(m & own != 0 AND m & before = 0, 1, 0)"
    shares = " ".join(f"WHEN {j} THEN {120 // j}" for j in range(1, len(FILTERS) + 1))
    return rows.select(
        "part",
        "filter_order",
        "step",
        over("every", "IF(m & (own | before) = 0, 1, 0)").alias("kept"),
        over("every", here).alias("removed"),
        over("every", "IF(m & own != 0 AND m & before != 0, 1, 0)").alias("redundant"),
        F.get("every", F.col("own")).alias("unique_fails"),
        over("good", here).alias("good_lost"),
        over("toxic", here).alias("toxic_lost"),
        over("every", f"IF(m & own != 0, CASE bit_count(m) {shares} END, 0)").alias("shapley"),
    )
