"""Substring deduplication by super-k-mers: long passages that repeat anywhere lose all their words.

A window is WINDOW consecutive words.  Its minimiser is the least hash of the runs of a few words in it; consecutive
windows that share theirs make a super-k-mer, which travels as one packed string to its minimiser's bucket.  There the
windows of all packed strings are sorted and counted as they are, byte for byte.  Equal windows have equal minimisers, so
they meet in one bucket.

Three things keep the movement small and the buckets even:

- First only minimisers travel.  A window can only repeat if its minimiser stands at two places, so packed strings are made
  for the others alone.
- Equal packed strings are one string and a count before they are dealt out, so copies of a passage don't add up.
- A bucket of more than CROWD super-k-mers (a phrase that very many texts share) is counted over all tasks: its windows'
  128-bit digests are grouped like any other key, with partial counts.

Defined results: null or empty text has no words; a text of fewer words than a window keeps all; a window that repeats
inside one document is removed in both places; rows that repeat a doc_id are documents each, so each one's windows stand
elsewhere too; very long words travel as their SHA-256; an empty table gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyline.llm.common import ROW, ROW_TYPE, durable, numbered, settled, stored

WINDOW = 35
#: Windows of a super-k-mer at most, so that a mark for each of them fits a long.
MOST = 63
#: Super-k-mers of a minimiser from which its windows are counted over all tasks.
CROWD = 4096
#: Words that a task remembers the hashes of, and packed strings that it remembers having sent; bytes of a word as it is.
KNOWN, SENT, WORD = 1 << 18, 1 << 17, 64
MIXER = np.uint64(0x9E3779B97F4A7C15)
ZSTD = pa.Codec("zstd", 3)


class WordHashes(dict):
    """XXH64 of words, remembered up to a number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        made = self[word] = xxhash.xxh64_intdigest(word)
        return made


def shape_of(window: int) -> tuple[int, int]:
    """Words of a k-mer, a power of two, and windows of a super-k-mer at most."""
    k = 1 << max(0, (window // 4).bit_length() - 1)
    return k, min(window - k + 1, MOST)


def super_kmers(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text's word hashes: each super-k-mer's first word, number of windows, minimiser, and places (1, or 2 for more).

    Places are of the minimiser: where a k-mer stands twice in one text, a window may repeat without leaving its super-k-mer.
    """
    n = len(hashes) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    k, most = shape_of(window)
    grams, step = hashes, 1
    while step < k:
        grams = grams[:-step] * MIXER + grams[step:]
        grams ^= grams >> np.uint64(31)
        step *= 2
    grams = grams * MIXER
    grams ^= grams >> np.uint64(29)
    spread = window - k + 1
    least, step = grams, 1
    while 2 * step <= spread:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < spread:
        least = np.minimum(least[: n], least[spread - step :])
    starts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    sizes = np.diff(np.append(starts, n))
    if (sizes > most).any():  # a k-mer that comes again and again carries on; its run is cut
        parts = -(-sizes // most)
        within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = np.repeat(starts, parts) + within * most
        sizes = np.diff(np.append(starts, n))
    minimisers = least[starts]
    kinds, times = np.unique(grams, return_counts=True)
    places = 1 + np.isin(minimisers, kinds[times > 1])
    return starts, sizes, minimisers.view(np.int64), places


def surveyed(docs: DataFrame, window: int) -> DataFrame:
    """Rows (row, doc_id, n_words, words_sha256, supers): supers an array of (start, windows, m, places)."""
    kind = pa.struct([("start", pa.int32()), ("windows", pa.int32()), ("m", pa.int64()), ("places", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            sizes, digests, found, ends = [], [], [], [0]
            for text in batch.column(2):
                words = (text.as_py() or b"").split()  # bytes.split() cuts at U+0020 and U+0009 to U+000D alone
                sizes.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words)) if len(words) >= window else np.zeros(0, np.uint64)
                found.append(super_kmers(hashes, window))
                ends.append(ends[-1] + len(found[-1][0]))
            cols = [pa.array(np.concatenate(c)).cast(f.type) for c, f in zip(zip(*found, strict=True), kind, strict=True)] if found else [pa.array([], f.type) for f in kind]
            supers = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(cols, fields=list(kind)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), supers],
                ["row", "doc_id", "n_words", "words_sha256", "supers"],
            )

    rows = numbered(docs).select(F.col(ROW).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    shape = f"row {ROW_TYPE}, doc_id long, n_words long, words_sha256 string, supers array<struct<start: int, windows: int, m: long, places: int>>"
    return rows.mapInArrow(run, shape)


def squeezed(text: bytes) -> bytes:
    return len(text).to_bytes(8, "little") + ZSTD.compress(text, asbytes=True)


def unsqueezed(z: bytes) -> bytes:
    return ZSTD.decompress(z[8:], int.from_bytes(z[:8], "little"), asbytes=True)


def words_of(z: bytes) -> list[bytes]:
    return unsqueezed(z).split()


def compressed(docs: DataFrame) -> DataFrame:
    """Rows (row, z): the texts as they travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [squeezed(x.as_py() or b"") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["row", "z"])

    rows = numbered(docs).select(F.col(ROW).alias("row"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"row {ROW_TYPE}, z binary")


def packed(needed: DataFrame, window: int) -> DataFrame:
    """Rows (m, crowded, same, row, start, packed) from rows (row, z, supers).

    `same` is a digest of the packed string, which a task sends only the first time that it meets it.
    """
    names = ["m", "crowded", "same", "row", "start", "packed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for batch in batches:
            at, out = [], []
            for i, (z, supers) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
                words = [w if len(w) <= WORD else b"\t" + hashlib.sha256(w).hexdigest().encode() for w in words_of(z.as_py())]
                for s in supers.as_py():
                    start, windows = s["start"], s["windows"]
                    text = b" ".join(words[start : start + windows + window - 1])
                    same = xxhash.xxh3_128_digest(text)
                    if len(sent) >= SENT:
                        sent.clear()
                    out.append((s["m"], s["crowded"], same, start, None if same in sent else text))
                    sent.add(same)
                    at.append(i)
            if out:
                m, crowded, same, start, text = zip(*out, strict=True)
                cols = [pa.array(m, pa.int64()), pa.array(crowded, pa.bool_()), pa.array(same, pa.binary()), batch.column(0).take(pa.array(at, pa.int32())), pa.array(start, pa.int32()), pa.array(text, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names)

    return needed.select("row", "z", "supers").mapInArrow(run, f"m long, crowded boolean, same binary, row {ROW_TYPE}, start int, packed binary")


def windows_in(text: bytes, window: int) -> list[bytes]:
    """The windows of a packed string, in order."""
    data = np.frombuffer(text, np.uint8)
    gaps = np.flatnonzero(data == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.append(gaps, len(data))
    return [text[a:b] for a, b in zip(starts[: len(starts) - window + 1].tolist(), ends[window - 1 :].tolist(), strict=True)]


def counted(strings: list[tuple[bytes, bytes, int]], window: int) -> dict[bytes, int]:
    """Of a bucket's different (same, packed, times): marks of the windows that stand at two places or more, by `same`."""
    every = sorted((w, k, j) for k, (_, text, _) in enumerate(strings) for j, w in enumerate(windows_in(text, window)))
    marks = [0] * len(strings)
    i = 0
    while i < len(every):
        j, times = i, 0
        while j < len(every) and every[j][0] == every[i][0]:
            times += strings[every[j][1]][2]
            j += 1
        if times > 1:
            for _, k, place in every[i:j]:
                marks[k] |= 1 << place
        i = j
    return {strings[k][0]: mark for k, mark in enumerate(marks) if mark}


def bucket_marks(strings: DataFrame, window: int) -> DataFrame:
    """Rows (same, marks) from rows (m, same, packed, times), each bucket in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes, int]] = []
        at = None

        def made() -> pa.RecordBatch:
            marks = counted(held, window)
            return pa.RecordBatch.from_arrays([pa.array(list(marks), pa.binary()), pa.array(list(marks.values()), pa.int64())], ["same", "marks"])

        for batch in batches:
            for m, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if m != at and held:
                    yield made()
                    held = []
                at = m
                held.append(tuple(rest))
        if held:
            yield made()

    rows = strings.select("m", "same", "packed", "times").repartition("m").sortWithinPartitions("m", "same")
    return rows.mapInArrow(run, "same binary, marks long")


def spread_marks(strings: DataFrame, window: int) -> DataFrame:
    """The same for crowded buckets: windows are counted by their digests over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same, text, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                digests = [xxhash.xxh3_128_digest(w) for w in windows_in(text, window)]
                n = len(digests)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([same] * n, pa.binary()), pa.array(range(n), pa.int32()), pa.array([times] * n, pa.int64()), pa.array(digests, pa.binary())],
                    ["same", "place", "times", "digest"],
                )

    rows = durable(strings.select("same", "packed", "times").mapInArrow(run, "same binary, place int, times long, digest binary"))
    many = durable(rows.groupBy("digest").agg(F.sum("times").alias("n")).where("n > 1").select("digest"))
    found = rows.join(many.hint("merge"), "digest", "left_semi")
    return found.groupBy("same").agg(F.expr("bit_or(shiftleft(1L, place))").alias("marks"))


def repeated(docs: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Rows (row, doc_id, n_words, words_sha256) of all docs, and (row, z, found) of those with windows that repeat.

    found is an array of (start, marks): mark j says that the window at word start + j repeats.  docs must be settled.
    """
    base = stored(surveyed(docs, window))
    supers = base.select("row", F.explode("supers").alias("s")).select("row", "s.*")
    often = durable(supers.groupBy("m").agg(F.sum("places").alias("n")).where("n > 1"))
    wanted = supers.join(often.hint("merge"), "m")
    super_of = F.struct("start", "windows", "m", (F.col("n") > CROWD).alias("crowded"))
    wanted = wanted.groupBy("row").agg(F.collect_list(super_of).alias("supers"))
    needed = stored(compressed(docs).join(wanted.hint("merge"), "row"))
    places = stored(packed(needed, window))
    strings = places.groupBy("m", "crowded", "same").agg(F.max("packed").alias("packed"), F.count("*").alias("times"))
    strings = stored(strings)
    marks = bucket_marks(strings.where("NOT crowded"), window).unionByName(spread_marks(strings.where("crowded"), window))
    found = places.select("same", "row", "start").join(durable(marks).hint("merge"), "same")
    found = found.groupBy("row").agg(F.collect_list(F.struct("start", "marks")).alias("found"))
    return base.drop("supers"), needed.select("row", "z").join(found.hint("merge"), "row")


def kept_words(words: list[bytes], found: list[dict], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the spans of words that repeating windows cover."""
    covers = np.zeros(len(words) + 1, np.int64)
    for f in found:
        marks = f["marks"] & (2**64 - 1)
        at = f["start"] + np.flatnonzero([marks >> j & 1 for j in range(marks.bit_length())])
        np.add.at(covers, at, 1)
        np.add.at(covers, at + window, -1)
    inside = np.concatenate([[False], np.cumsum(covers[:-1]) > 0, [False]])
    return np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])


def cut(touched: DataFrame, window: int, texts: bool) -> DataFrame:
    """Rows (row, spans, n_removed, kept_sha256, kept_text) from (row, z, found); without `texts` kept_text is null."""
    span = pa.struct([("begin", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, gone, digests, kept = [], [], [], []
            for z, found in zip(batch.column(1), batch.column(2), strict=True):
                words = words_of(z.as_py())
                begins, ends = (x.tolist() for x in kept_words(words, found.as_py(), window))
                text = b" ".join(w for a, b in zip([0, *ends], [*begins, len(words)], strict=True) for w in words[a:b])
                spans.append([{"begin": a, "end": b} for a, b in zip(begins, ends, strict=True)])
                gone.append(sum(ends) - sum(begins))
                digests.append(hashlib.sha256(text).hexdigest())
                kept.append(text.decode() if texts else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(spans, pa.list_(span)), pa.array(gone, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.string())],
                ["row", "spans", "n_removed", "kept_sha256", "kept_text"],
            )

    shape = f"row {ROW_TYPE}, spans array<struct<begin: int, end: int>>, n_removed long, kept_sha256 string, kept_text string"
    return touched.select("row", "z", "found").mapInArrow(run, shape)


def removals(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256, spans (begin, end) of the words removed."""
    base, touched = repeated(settled(docs), window)
    rows = base.join(cut(touched, window, texts=False).hint("merge"), "row", "left")
    none = F.array().cast("array<struct<begin: int, end: int>>")
    return rows.select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept_sha256", "words_sha256").alias("kept_sha256"), F.coalesce("spans", none).alias("spans"),
    )


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs; a text that loses words becomes those that stay, joined by one space, any other stays as it is."""
    docs = settled(docs)
    _, touched = repeated(docs, window)
    made = cut(touched, window, texts=True).select(F.col("row").alias(ROW), F.col("kept_text").alias("_rl_kept"))
    rows = numbered(docs).join(made.hint("merge"), ROW, "left")
    return rows.withColumn("text", F.coalesce("_rl_kept", "text")).select(docs.columns)
