"""Ranked lexical search by block-max pruning.

The index is a table of blocks.  A block is a range of documents that stand together: their ids and lengths, a forward
index (each document's terms and how often it has them), and for each of the block's terms the maximum of what the term
can add to any of its documents.  A query's bound for a block is the sum of these maxima by its weights.

A search reads the maxima alone first: the blocks with each query's highest bounds are scored in full, which gives a score
that the query's tenth document has at least.  Then each task sorts its blocks by bound and scores them until the bound
drops below that threshold, or below the tenth best score of the task itself, whichever is higher.  A block that is left out
can't hold a result, ties included, so results are exact.

Queries go to the tasks in batches of a bounded number of terms; one pass over the index serves a batch.  No row of the
index moves, and what comes back is the few documents over the thresholds.

Defined results: null text has no terms, and a document without terms is in no block; a query without terms, or one whose
terms no document has, gets no rows; a term that a query repeats counts each time; rows that repeat an item_id are queries
each; rows that repeat a doc_id are documents each; of equal scores null ids come last; an empty table of either kind gives
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rallyline.llm.common import UPPER, durable, stored
from rallyline.llm.passages import squeezed, unsqueezed

#: The term rule, and the numbers of the score.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SCALE, LENGTH_SHARE, SATURATION = 1000, 75, 8
#: Documents of a block, and terms at which it ends before that.
BLOCK, BLOCK_TERMS = 64, 1 << 17
#: Blocks that a task sorts at a time.
GROUP = 64
#: Queries and terms of a batch, at most; a query of more terms is a batch of its own.
QUERIES, TERMS = 2048, 1 << 18
#: Blocks of each query that give its first threshold.
FIRST = 4
#: Scores below this are exact as sums of doubles.
EXACT = 1 << 53
#: The arrays of a block.
KINDS = {"sizes": np.int64, "peaks": np.int64, "holders": np.int32, "ends": np.int32, "at": np.int32, "times": np.int32}


def _spaced() -> bytes:
    """What bytes.translate() needs to leave A-Z in lower case, digits, a-z and all of UTF-8's other bytes."""
    return bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).translate(bytes.maketrans(UPPER.encode(), UPPER.lower().encode()))


SPACED = _spaced()


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(SPACED).split()


@dataclass
class Index:
    """blocks: rows (block, ids, terms, sizes, peaks, holders, ends, at, times); documents and length: N and L of the score.

    terms, peaks and holders (how many documents hold it) are parallel; at and times hold the documents' terms end to end,
    as places in terms and numbers of times, and ends says where each document's end.  All but ids are bytes under
    Zstandard, see rows_of: a block is some hundred KB as arrays, and a task's rows travel together.
    """

    blocks: DataFrame
    documents: int
    length: int


def impacts(times: np.ndarray, sizes: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What a term adds for each unit of its weight to a document of so many terms, rounded down in 64 bits."""
    share = 100 - LENGTH_SHARE + LENGTH_SHARE * sizes * documents // length
    return SCALE**3 * times // (SCALE * times + SATURATION * share)


def indexed(docs: DataFrame, block: int = BLOCK) -> Index:
    """The index of docs (doc_id, text), stored."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(terms_of(text.as_py())) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([sum(map(bool, sizes))], pa.int64()), pa.array([sum(sizes)], pa.int64())], ["documents", "terms"])

    n, length = rows.select("text").mapInArrow(count, "documents long, terms long").agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 33, 0
        ids: list[int | None] = []
        texts: list[list[bytes]] = []
        held = 0

        def whole() -> pa.RecordBatch:
            places: dict[bytes, int] = {}
            parts = [np.unique(np.fromiter((places.setdefault(t, len(places)) for t in terms), np.int32, len(terms)), return_counts=True) for terms in texts]
            sizes = np.array([len(terms) for terms in texts], np.int64)
            counts = np.array([len(p) for p, _ in parts], np.int64)
            at, times = (np.concatenate(x).astype(np.int32) for x in zip(*parts, strict=True))
            peaks = np.zeros(len(places), np.int64)
            np.maximum.at(peaks, at, impacts(times.astype(np.int64), np.repeat(sizes, counts), n, length))
            columns = {"sizes": sizes, "peaks": peaks, "holders": np.bincount(at, minlength=len(places)), "ends": np.cumsum(counts), "at": at, "times": times}
            packed = {"terms": b" ".join(places)} | {name: column.astype(KINDS[name]).tobytes() for name, column in columns.items()}
            return pa.RecordBatch.from_arrays(
                [pa.array([first + made], pa.int64()), pa.array([ids], pa.list_(pa.int64())), *[pa.array([squeezed(x)], pa.binary()) for x in packed.values()]],
                ["block", "ids", *packed],
            )

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if terms := terms_of(text.as_py()):
                    ids.append(i)
                    texts.append(terms)
                    held += len(terms)
                if len(ids) >= block or held >= BLOCK_TERMS:
                    yield whole()
                    ids, texts, held, made = [], [], 0, made + 1
        if ids:
            yield whole()

    shape = "block long, ids array<long>, terms binary, " + ", ".join(f"{name} binary" for name in KINDS)
    return Index(stored(rows.mapInArrow(run, shape)), n, length)


class Batch:
    """Queries as numbers: each one's own terms, by their number in the batch, and how often it has them."""

    def __init__(self, queries: list[list[bytes]]) -> None:
        self.place: dict[bytes, int] = {}
        self.terms: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        for terms in queries:
            numbers = [self.place.setdefault(t, len(self.place)) for t in terms]
            own, times = np.unique(np.array(numbers, np.int64), return_counts=True)
            self.terms.append(own)
            self.times.append(times)

    def weigh(self, holders: np.ndarray, documents: int) -> None:
        weight = np.floor(SCALE * np.log((2 * documents + 2) / (2 * holders + 1))).astype(np.int64) if len(holders) else holders
        self.weights = [weight[t] * n for t, n in zip(self.terms, self.times, strict=True)]
        # as numbers of one long array: where each query starts, for sums over all queries at once
        self.starts = np.cumsum([0, *[len(t) for t in self.terms]])[:-1]
        self.every, self.all_weights = np.concatenate(self.terms), np.concatenate(self.weights)

    def bounds(self, terms: list[bytes], peaks: np.ndarray) -> np.ndarray:
        """Each query's bound for a block."""
        best = np.zeros(len(self.place), np.int64)
        mine = [(self.place[t], i) for i, t in enumerate(terms) if t in self.place]
        if mine:
            numbers, at = np.array(mine).T
            best[numbers] = peaks[at]
        return np.add.reduceat(best[self.every] * self.all_weights, self.starts)


class Block:
    """A row of the index, ready to be scored."""

    def __init__(self, row: dict, batch: Batch, documents: int, length: int) -> None:
        self.ids, self.batch = row["ids"], batch
        number = np.full(len(row["terms"]), -1, np.int64)
        for i, t in enumerate(row["terms"]):
            number[i] = batch.place.get(t, -1)
        ends = row["ends"]
        owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        mine = number[row["at"]] >= 0
        owner, at, times = owner[mine], row["at"][mine], row["times"][mine].astype(np.int64)
        kinds, self.row = np.unique(number[row["at"]][mine], return_inverse=True)
        self.line = np.full(len(batch.place), -1, np.int64)
        self.line[kinds] = np.arange(len(kinds))
        self.table = np.zeros((len(kinds), len(ends)), np.int64)
        self.table[self.row, owner] = impacts(times, row["sizes"][owner], documents, length)

    def scores(self, q: int) -> np.ndarray:
        """Each document's score for a query."""
        line = self.line[self.batch.terms[q]]
        weights = self.batch.weights[q][line >= 0]
        part = self.table[line[line >= 0]]
        if float(weights.sum()) * SCALE**2 < EXACT:  # doubles multiply faster and lose nothing
            return (weights.astype(np.float64) @ part.astype(np.float64)).astype(np.int64)
        return weights @ part


class Best:
    """A query's best documents so far, as (score, id): highest scores, then smallest ids, null ids last."""

    def __init__(self, k: int, least: int) -> None:
        self.k, self.least, self.rows = k, max(1, least), []

    def add(self, scores: np.ndarray, ids: list[int | None]) -> None:
        for i in np.flatnonzero(scores >= self.least).tolist():
            self.rows.append((int(scores[i]), ids[i]))
        if len(self.rows) > self.k:
            self.rows = sorted(self.rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0))[: self.k]
            self.least = max(self.least, self.rows[-1][0])


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a part of the index, one at a time, with terms as a list and the rest as arrays."""
    for i in range(batch.num_rows):
        row = {}
        for name in batch.schema.names:
            value = batch.column(name)[i].as_py()
            row[name] = value if name in ("block", "ids") else unsqueezed(value).split() if name == "terms" else np.frombuffer(unsqueezed(value), KINDS[name])
        yield row


def holders_of(index: Index, batch: Batch) -> np.ndarray:
    """In how many documents of the index each of the batch's terms stands."""
    shared = index.blocks.sparkSession.sparkContext.broadcast(batch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value.place
        total = np.zeros(len(place), np.int64)
        for part in batches:
            for row in rows_of(part):
                for t, n in zip(row["terms"], row["holders"].tolist(), strict=True):
                    if (at := place.get(t)) is not None:
                        total[at] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "n"])

    rows = index.blocks.select("terms", "holders").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(len(batch.place), np.int64)
    for r in rows:  # as many as the batch has terms, at most
        found[r["term"]] = r["n"]
    shared.unpersist()
    return found


def first_blocks(index: Index, shared, least: int = 1) -> list[int]:
    """The FIRST blocks of each query by bound; from the maxima alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = shared.value
        best: list[list[tuple[int, int]]] = [[] for _ in batch.terms]
        for part in batches:
            for row in rows_of(part):
                for q, bound in enumerate(batch.bounds(row["terms"], row["peaks"]).tolist()):
                    if bound >= least and (len(best[q]) < FIRST or bound > best[q][-1][0]):
                        best[q] = sorted([*best[q], (bound, row["block"])], reverse=True)[:FIRST]
        out = [(q, bound, block) for q, own in enumerate(best) for bound, block in own]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["q", "bound", "block"])

    rows = index.blocks.select("block", "terms", "peaks").mapInArrow(run, "q long, bound long, block long")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "block"))
    return [r["block"] for r in rows.withColumn("rank", rank).where(F.col("rank") <= FIRST).select("block").distinct().collect()]


def scored(blocks: DataFrame, shared, index: Index, k: int, least: list[int]) -> DataFrame:
    """Rows (q, doc_id, score): each task's k best documents of each query, none of them under the query's least score."""
    documents, length = index.documents, index.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = shared.value
        best = [Best(k, x) for x in least]

        def search(group: list[dict]) -> None:
            bounds = np.stack([batch.bounds(row["terms"], row["peaks"]) for row in group])
            ready: dict[int, Block] = {}
            for q in np.flatnonzero(bounds.max(0) >= np.array([b.least for b in best])).tolist():
                for i in np.argsort(-bounds[:, q], kind="stable").tolist():
                    if bounds[i, q] < best[q].least:
                        break
                    if i not in ready:
                        ready[i] = Block(group[i], batch, documents, length)
                    best[q].add(ready[i].scores(q), ready[i].ids)

        group: list[dict] = []
        for part in batches:
            for row in rows_of(part):
                group.append(row)
                if len(group) == GROUP:
                    search(group)
                    group = []
        if group:
            search(group)
        out = [(q, doc_id, score) for q, b in enumerate(best) for score, doc_id in b.rows]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["q", "doc_id", "score"])

    return blocks.select("block", "ids", "sizes", "terms", "peaks", "ends", "at", "times").mapInArrow(run, "q long, doc_id long, score long")


def ranked(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def batches_of(queries: DataFrame) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """The queries in lists of (item_id, terms) that come to the driver one at a time, each of a bounded size."""
    rows = durable(queries.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")))
    held, n = [], 0
    for r in rows.toLocalIterator():
        terms = terms_of(bytes(r["text"] or b""))
        if not terms:
            continue
        if held and (len(held) == QUERIES or n + len(terms) > TERMS):
            yield held
            held, n = [], 0
        held.append((r["item_id"], terms))
        n += len(terms)
    if held:
        yield held


def top_documents(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the k best documents of the index for each query (item_id, text)."""
    spark = queries.sparkSession
    found = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for held in batches_of(queries) if index.documents else ():
        batch = Batch([terms for _, terms in held])
        batch.weigh(holders_of(index, batch), index.documents)
        shared = spark.sparkContext.broadcast(batch)
        chosen = spark.createDataFrame([(b,) for b in first_blocks(index, shared)], "block long")  # FIRST for each query at most
        least = [1] * len(held)
        first = scored(index.blocks.join(F.broadcast(chosen), "block", "left_semi"), shared, index, k, least)
        for r in ranked(first, k).where(F.col("rank") == k).collect():
            least[r["q"]] = r["score"]
        names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(held)], "q long, item_id long")
        rows = durable(ranked(scored(index.blocks, shared, index, k, least), k))
        found = found.unionByName(rows.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score"))
        shared.unpersist()
    return found
