"""Quality by a language model: interpolated modified Kneser-Ney over character n-grams, trained on trusted text.

Every table of the model is a DataFrame keyed by the n-gram itself, a string of 1 to 4 characters of any script: counts
of the highest order from the trusted documents, continuation counts of each lower order by grouping the order above,
contexts' totals and back-off weights by grouping again, probabilities by joining each order with the one below.  All of
them are dealt by n-gram or context, so none is gathered or broadcast.

Documents are scored by count joins as well.  Rows that stand together in a file make blocks of some 12 MB of text; a block's distinct
n-grams, far fewer than its characters, are joined with the tables, and the probabilities come back to the block, where
each document's perplexity is that of its own n-grams.  So each text moves once, and n-grams move once for each block,
not once for each document.

Trusted documents are those with label quality 1.  A threshold for each language is a high quantile of their own
perplexities; a short text, whose perplexity is mostly chance, is allowed a little more.

Digits count as one character and so do all kinds of white space; everything else counts as it stands.

Defined results: null or empty text has no perplexity and is rejected; a language without trusted documents (or a null
one) takes the quantile of all trusted documents; without any, nothing but empty text is rejected; rows that repeat a
doc_id are judged each; labels that repeat count once, and rows without an id are trusted by none; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyline.llm.common import ROW, ROW_TYPE, durable, give_back, numbered, settled, stored

ORDER = 4
#: Characters that are counted at a time, and bytes of text of a block.
CHUNK, BLOCK = 1 << 18, 12 << 20
#: Of the trusted documents of a language, the share whose perplexity is under the threshold; accuracy of the quantile;
#: what a text of n characters is allowed for chance, as exp(CHANCE / sqrt(n)) times the threshold.
QUANTILE, ACCURACY, CHANCE = 0.995, 10_000, 2.0
#: Bits of the filter that spares text without a label the way to the labels.
FILTER = 1 << 23
#: Languages whose thresholds are broadcast at most.
LANGUAGES = 10_000
MIXER = np.uint64(0x9E3779B97F4A7C15)
ZSTD = pa.Codec("zstd", 3)


def _folded() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    table[[0, *range(9, 14)]] = ord(" ")
    table[ord("0") : ord("9") + 1] = ord("0")
    return table


FOLDED = _folded()


def code_points(text: str | None) -> np.ndarray:
    points = np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)
    return np.where(points < 256, FOLDED[np.minimum(points, 255)], points)


def chunks(texts: Iterable[str | None], size: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Code points of many texts end to end and the text that each belongs to, -1 for those that are context alone.

    Zeros stand before a text, and where a long one is cut its last characters are repeated.
    """
    held: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    n = 0
    for i, text in enumerate(texts):
        points, context = code_points(text), np.zeros(ORDER - 1, np.uint32)
        for k in range(0, len(points), size):
            body = points[k : k + size]
            held += [context, body]
            owners += [np.full(ORDER - 1, -1), np.full(len(body), i)]
            context = np.concatenate([context, body])[1 - ORDER :]
            n += len(body)
            if n >= size:
                yield np.concatenate(held), np.concatenate(owners)
                held, owners, n = [], [], 0
    if n:
        yield np.concatenate(held), np.concatenate(owners)


def gram_keys(points: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the n-gram that ends at each point from the ORDER-th on."""
    n = len(points) - ORDER + 1
    keys = np.zeros(n, np.uint64)
    for j in range(ORDER):
        keys = (keys ^ points[j : j + n]) * MIXER
        keys ^= keys >> np.uint64(29)
    return keys


def distinct_grams(texts: Iterable[str | None]) -> tuple[list[str], np.ndarray]:
    """The n-grams of the texts, each once, and their counts."""
    keys, counts, codes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, ORDER), np.uint32)
    for points, owners in chunks(texts):
        ends = np.flatnonzero(owners[ORDER - 1 :] >= 0)
        new, at, n = np.unique(gram_keys(points)[ends], return_index=True, return_counts=True)
        keys, first, of = np.unique(np.concatenate([keys, new]), return_index=True, return_inverse=True)
        codes = np.concatenate([codes, np.lib.stride_tricks.sliding_window_view(points, ORDER)[ends[at]]])[first]
        counts = np.bincount(of, np.concatenate([counts, n]), len(keys)).astype(np.int64)
    every = codes.astype("<u4").tobytes().decode("utf-32-le")
    return [every[k : k + ORDER] for k in range(0, len(every), ORDER)], counts


def block_of(docs: DataFrame) -> Column:
    """The block of a row of numbered docs: rows that stand together in a file, in the same block however they are read.

    As many rows make a block as have some BLOCK bytes by the mean text.  Texts of up to 32 times the mean are in these;
    those of up to four times that are in blocks of a quarter of the rows, and so on, so no block holds over 32 times BLOCK.
    """
    n, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    mean = 64 + (size or 0) / max(1, n)
    rows = 1 << max(0, round(math.log2(BLOCK / mean)))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    level = F.when(size <= 32 * mean, 0).otherwise(F.ceil(F.log(4.0, size / (32 * mean)))).cast("int")
    place = F.floor(F.col(ROW)["at"] / F.greatest(F.lit(1), F.floor(rows / F.pow(F.lit(4.0), level))))
    return F.xxhash64(F.col(ROW)["file"], level, place.cast("long"))


def squeezed(text: pa.Scalar) -> bytes | None:
    """A text as it moves: Zstandard, behind its size."""
    data = text.as_buffer()
    return None if data is None else data.size.to_bytes(8, "little") + ZSTD.compress(data, asbytes=True)


def unsqueezed(data: bytes | None) -> str | None:
    return None if data is None else ZSTD.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True).decode()


def good_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def trusted_text(docs: DataFrame, labels: DataFrame, bits: int = FILTER) -> DataFrame:
    """Rows (packed) of documents with label quality 1: their squeezed texts.

    A filter of a fixed number of bits keeps most other text from moving; the join decides.
    """
    good = good_ids(labels)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    marked = good.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("at"))
    words = marked.agg(F.expr("bit_or(shiftleft(1L, CAST(p % 64 AS INT)))").alias("w")).toPandas()
    made = np.zeros(bits // 64, np.int64)
    made[words["at"].to_numpy(np.int64)] = words["w"].to_numpy(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(made.view(np.uint64))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for batch in batches:
            p = batch.column(2).to_numpy().astype(np.uint64)
            hit = (of[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1)
            rows = batch.select([0, 1]).filter(pa.array(hit.astype(bool)))
            packed = pa.array([squeezed(t) for t in rows.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column(0), packed], ["doc_id", "packed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text <> ''")
    rows = rows.select("doc_id", "text", place.alias("p")).mapInArrow(likely, "doc_id long, packed binary")
    return rows.join(good.hint("merge"), "doc_id", "left_semi").select("packed")


def gram_counts(packed: DataFrame) -> DataFrame:
    """Rows (g, n): how often each n-gram stands in the squeezed texts, summed in each task before they meet."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[str]:
            for batch in batches:
                for data in batch.column(0):
                    yield unsqueezed(data.as_py())

        grams, n = distinct_grams(rows())
        for k in range(0, len(grams), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(grams[k : k + 10_000], pa.string()), pa.array(n[k : k + 10_000])], ["g", "n"])
        del grams, n
        give_back()

    return packed.mapInArrow(count, "g string, n long").groupBy("g").agg(F.sum("n").alias("n"))


def discounts(n: list[int]) -> list[float]:
    """The discounts of counts 1, 2 and 3 or more, from how many n-grams have counts 1, 2, 3 and 4."""
    if min(n[:3]) == 0:
        return [0.5, 0.75, 0.9]
    y = n[0] / (n[0] + 2 * n[1])
    made = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
    return [min(max(d, 0.05), k - 0.05) for k, d in enumerate(made, 1)]


def last(k: int) -> Column:
    return F.substring("g", -k, k) if k else F.lit("")


@dataclass
class Model:
    """By order from 1: known, rows (g, p) of the n-grams that occur; contexts, rows (context, weight).

    spread: what an unseen character of order 1 has, the back-off weight times one share of the alphabet.
    """

    known: list[DataFrame]
    contexts: list[DataFrame]
    spread: float

    def probabilities(self, grams: DataFrame, order: int = ORDER) -> DataFrame:
        """Rows (g, p) for distinct n-grams (g) of an order; where one is unknown, its context's weight times the order below."""
        found = grams.join(self.known[order - 1], "g", "left")
        if order == 1:
            return found.select("g", F.coalesce("p", F.lit(self.spread)).alias("p"))
        found = durable(found)
        open_ = found.where("p IS NULL").select("g", F.substring("g", 1, order - 1).alias("context"), last(order - 1).alias("below"))
        below = self.probabilities(open_.select(F.col("below").alias("g")).distinct(), order - 1)
        open_ = open_.join(self.contexts[order - 1], "context", "left").join(below.withColumnRenamed("g", "below"), "below")
        rest = open_.select("g", (F.coalesce("weight", F.lit(1.0)) * F.col("p")).alias("p"))
        return durable(found.where("p IS NOT NULL").unionByName(rest))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    counts = {ORDER: durable(gram_counts(trusted_text(docs, labels)))}
    for k in range(ORDER - 1, 0, -1):  # how many n-grams of the order above end in this one
        counts[k] = durable(counts[k + 1].groupBy(last(k).alias("g")).agg(F.count("*").alias("n")))
    known, contexts, spread = [], [], 1.0
    for k in range(1, ORDER + 1):
        of = [F.count_if(F.col("n") == i) for i in (1, 2, 3, 4)]
        *ones, threes, total, size = counts[k].agg(*of, F.count_if(F.col("n") >= 3), F.sum("n"), F.count("*")).first()
        d = discounts(ones)
        cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        rows = counts[k].select("g", "n", cut.alias("cut"), F.substring("g", 1, k - 1).alias("context"), last(k - 1).alias("below"))
        if k == 1:  # one context, the empty one
            cuts = ones[0] * d[0] + ones[1] * d[1] + threes * d[2]
            spread = cuts / total / (size + 1) if total else 1.0
            known.append(durable(rows.select("g", ((F.col("n") - F.col("cut")) / F.lit(float(total or 1)) + spread).alias("p"))))
            contexts.append(rows.limit(0))
            continue
        totals = rows.groupBy("context").agg(F.sum("n").alias("total"), (F.sum("cut") / F.sum("n")).alias("weight"))
        totals = durable(totals)
        rows = rows.join(totals, "context").join(known[-1].select(F.col("g").alias("below"), F.col("p").alias("lower")), "below")
        p = (F.col("n") - F.col("cut")) / F.col("total") + F.col("weight") * F.col("lower")
        known.append(durable(rows.select("g", p.alias("p"))))
        contexts.append(totals.select("context", "weight"))
    return Model(known, contexts, spread)


def block_grams(rows: DataFrame) -> DataFrame:
    """Rows (block, g): the n-grams of each block of rows (block, text), each once for each task that reads of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[str]] = {}
        sizes: Counter[int] = Counter()

        def made(block: int) -> Iterator[pa.RecordBatch]:
            sizes.pop(block)
            grams, _ = distinct_grams(held.pop(block))
            for k in range(0, len(grams), 10_000):
                part = grams[k : k + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(part), pa.int64()), pa.array(part, pa.string())], ["block", "g"])

        for batch in batches:
            for block, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if text := text.as_py():
                    held.setdefault(block, []).append(text)
                    sizes[block] += len(text)
            while sizes.total() > 2 * BLOCK:
                yield from made(sizes.most_common(1)[0][0])
        for block in list(held):
            yield from made(block)
        give_back()

    return rows.select("block", "text").mapInArrow(run, "block long, g string")


def compressed(rows: DataFrame) -> DataFrame:
    """Rows (row, doc_id, lang, packed, block) from rows (row, doc_id, lang, text, block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = pa.array([squeezed(t) for t in batch.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], packed, batch.column(4)], ["row", "doc_id", "lang", "packed", "block"])
        give_back()

    return rows.select("row", "doc_id", "lang", "text", "block").mapInArrow(run, f"row {ROW_TYPE}, doc_id long, lang string, packed binary, block long")


def perplexities(texts: Iterable[str | None], size: int, grams: list[str], p: np.ndarray) -> list[float | None]:
    """Of each of `size` texts, None for an empty one; grams and p must hold every n-gram of the texts."""
    keys = gram_keys(np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32))[::ORDER]
    order = np.argsort(keys)
    keys, logs = keys[order], np.log(np.maximum(p, 1e-12))[order]
    total, n = np.zeros(size), np.zeros(size, np.int64)
    for points, owners in chunks(texts):
        ends = np.flatnonzero(owners[ORDER - 1 :] >= 0)
        own, wanted = owners[ORDER - 1 :][ends], gram_keys(points)[ends]
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        if (keys[at] != wanted).any():
            raise ValueError("a block's rows are not the ones that its n-grams came from: docs changed between two reads")
        total += np.bincount(own, logs[at], size)
        n += np.bincount(own, minlength=size)
    return [float(np.exp(-total[i] / n[i])) if n[i] else None for i in range(size)]


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs, which must be settled: row, doc_id, lang, perplexity, n_chars."""
    rows = numbered(docs).select(
        F.col(ROW).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
        F.col("text").cast("string").alias("text"), block_of(docs).alias("block"),
    )
    grams = stored(block_grams(rows))
    known = stored(grams.join(model.probabilities(grams.select("g").distinct()), "g"))

    def score(rows: pa.Table, of: pa.Table) -> pa.Table:
        sizes: list[int] = []

        def texts() -> Iterator[str | None]:
            for data in rows["packed"]:
                text = unsqueezed(data.as_py())
                sizes.append(len(text or ""))
                yield text

        made = perplexities(texts(), len(rows), of["g"].to_pylist(), of["p"].to_numpy())
        give_back()
        return pa.table([rows["row"], rows["doc_id"], rows["lang"], pa.array(made, pa.float64()), pa.array(sizes, pa.int64())],
                        ["row", "doc_id", "lang", "perplexity", "n_chars"])

    both = compressed(rows).groupBy("block").cogroup(known.groupBy("block"))
    return both.applyInArrow(score, f"row {ROW_TYPE}, doc_id long, lang string, perplexity double, n_chars long")


def judged(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """One row per row of docs: row, doc_id, lang, perplexity, threshold, kept."""
    docs = settled(docs)
    rows = durable(scored(docs, fit(docs, labels)))
    trusted = durable(rows.join(good_ids(labels).hint("merge"), "doc_id", "left_semi").select("lang", "perplexity"))
    limit = F.percentile_approx("perplexity", F.lit(quantile), F.lit(ACCURACY))
    overall = trusted.agg(limit).first()[0]
    by_lang = trusted.where("lang IS NOT NULL").groupBy("lang").agg(limit.alias("threshold"))
    # a language's threshold goes to its rows where they lie, unless languages are more than a broadcast should hold
    by_lang = durable(by_lang)
    rows = rows.join(by_lang.hint("broadcast" if by_lang.count() <= LANGUAGES else "merge"), "lang", "left")
    threshold = F.coalesce("threshold", F.lit(overall if overall is not None else float("inf")).cast("double"))
    allowed = F.exp(F.lit(CHANCE) / F.sqrt(F.greatest(F.col("n_chars"), F.lit(1))))
    kept = F.coalesce(F.col("perplexity") <= threshold * allowed, F.lit(False))
    return rows.select("row", "doc_id", "lang", "perplexity", threshold.alias("threshold"), kept.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """The rows of docs that the model doesn't reject."""
    docs = settled(docs)
    kept = judged(docs, labels, quantile).where("kept").select(F.col("row").alias(ROW))
    return numbered(docs).join(kept.hint("merge"), ROW, "left_semi").select(docs.columns)
