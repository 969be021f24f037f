"""Packing documents into training windows of equal capacity by Karmarkar-Karp multiway differencing.

A document's ids are cut into full windows and one rest.  The rests of a shard (a bounded number, dealt by hash) start
as partial partitions of one item each; the two with the largest imbalance merge again and again, the fullest window of
one with the emptiest of the other, until one partition is left, whose windows are nearly equal.  Where its fullest
window exceeds the capacity, the number of windows rises and the shard is partitioned anew.

Tokens are exact ids of the given tokenizer, whole texts by default.  Where the tokenizer's own description says that it
lower-cases, drops white space and parts words in the known way (see KNOWN), a worker encodes each distinct run of other
characters once and looks it up after that; every id comes from the tokenizer or its model.

Defined results: null and empty texts have the end id alone; rows that repeat a doc_id are packed each; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyline.llm.common import durable, give_back

#: Runs of characters, and words, that one worker keeps encoded; pieces that one shard packs, about.
KEPT, SHARD = 600_000, 1024
#: Printable ASCII and the letters of Latin-1, for which the pattern below parts a text as the tokenizer's does.
PLAIN = re.compile(r"[\x21-\x7E\xC0-\xD6\xD8-\xF6\xF8-\xFF]+\Z").match
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+").findall
#: The parts of a tokenizer's description by which its front end is the known one.
KNOWN = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [
            {"type": "NFC"},
            {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
            {"type": "Lowercase"},
        ],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}
#: By the tokenizer's path, for the life of a worker.
_known: dict = {}


#: By the number of ids.
_packers = [struct.Struct(f"<{n}I").pack for n in range(64)]


def pack_ids(ids: list[int]) -> bytes:
    return _packers[len(ids)](*ids) if len(ids) < len(_packers) else struct.pack(f"<{len(ids)}I", *ids)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Runs(dict):
    """Ids of white-space runs as bytes, found when first asked for.

    A run of plain Latin letters, digits and ASCII signs is parted by the tokenizer's own pattern, and the tokenizer's
    model encodes each new part; any other run goes through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.model, self.words = self.whole.model, {}
        # byte-level models write a byte as a printable character; those that are none count up from U+0100
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.shown = {b: 0x100 + i for i, b in enumerate(x for x in range(256) if x not in shown)}

    def __missing__(self, run: bytes) -> bytes:
        text = run.decode()
        if PLAIN(text) and "<|" not in text:
            words, out = self.words, []
            for part in PARTS(text.lower()):
                if part not in words:
                    shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.shown)
                    words[part] = pack_ids([t.id for t in self.model.tokenize(shown)])
                out.append(words[part])
            made = b"".join(out)
        else:
            made = pack_ids(self.whole.encode(text, add_special_tokens=False).ids)
        if len(self) >= KEPT:
            self.clear()
        if len(self.words) >= KEPT:
            self.words.clear()
        self[run] = made
        return made


def front_is_known(tokenizer) -> bool:
    """Whether the tokenizer parts and folds text as KNOWN says, and white space parts none of its added tokens."""
    made = json.loads(tokenizer.to_str())
    added = all("<|" in t["content"] and len(t["content"].split()) == 1 for t in made["added_tokens"])
    return added and made["model"]["type"] == "BPE" and all(made.get(k) == v for k, v in KNOWN.items())


class Encoder:
    """Ids of a whole text as little-endian unsigned 32-bit numbers, the end id last."""

    def __init__(self, path: str, end_id: int) -> None:
        if path not in _known:
            runs = Runs(path)
            _known[path] = runs, front_is_known(runs.whole)
        self.runs, self.known = _known[path]
        self.end = pack_ids([end_id])

    def __call__(self, text: bytes | None) -> bytes:
        text = text or b""
        if self.known:
            return b"".join(map(self.runs.__getitem__, text.split())) + self.end
        return pack_ids(self.runs.whole.encode(text.decode(), add_special_tokens=False).ids) + self.end


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """Rows (row, doc_id, start, length, ids_crc32, doc_tokens[, ids]): full windows and one rest for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer, end_id)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                names, starts, sizes, crcs, totals, ids = [], [], [], [], [], []
                for name, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    data = encode(text.as_py())
                    for start in range(0, len(data), 4 * capacity):
                        piece = data[start : start + 4 * capacity]
                        names.append(name)
                        starts.append(start // 4)
                        sizes.append(len(piece) // 4)
                        crcs.append(zlib.crc32(piece))
                        totals.append(len(data) // 4)
                        if with_ids:
                            ids.append(np.frombuffer(piece, "<u4").astype(np.int32))
                long = [pa.array(x, pa.int64()) for x in (names, starts, sizes, crcs, totals)]
                more = [pa.array(ids, pa.list_(pa.int32()))] if with_ids else []
                yield pa.RecordBatch.from_arrays([*long, *more], head)
        del encode
        give_back()

    head = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    shape = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, shape)


def _merge(a: tuple, b: tuple, k: int) -> tuple:
    """Two partial partitions, each (sums falling, items of each sum) with empty windows left out."""
    (x, p), (y, q) = a, b
    free = k - len(y)  # empty windows of b, which take the fullest of a
    if len(x) <= free:
        sums, items = list(x) + list(y), list(p) + list(q)
    else:
        sums, items = list(x[:free]), list(p[:free])
        rest = len(x) - free
        for i in range(rest):  # the fullest left of a with the emptiest of b
            sums.append(x[free + i] + y[len(y) - 1 - i])
            items.append(p[free + i] + q[len(y) - 1 - i])
        sums += y[: len(y) - rest]
        items += q[: len(q) - rest]
    order = sorted(range(len(sums)), key=sums.__getitem__, reverse=True)
    return [sums[i] for i in order], [items[i] for i in order]


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Items in k windows (some may be empty) of nearly equal sums."""
    heap = [(-s, i, [s], [(i,)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    mark = len(sizes)
    while len(heap) > 1:
        _, _, x, p = heapq.heappop(heap)
        _, _, y, q = heapq.heappop(heap)
        sums, items = _merge((x, p), (y, q), k)
        if len(sums) == k:  # only differences count
            least = sums[-1]
            sums = [s - least for s in sums]
        # windows that are level again keep their items, so they stay listed
        heapq.heappush(heap, (-(sums[0] - (sums[-1] if len(sums) == k else 0)), mark, sums, items))
        mark += 1
    return [list(w) for w in heap[0][3]] if heap else []


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Items in windows of at most the capacity: from the least number of windows up, until differencing fits them.

    The number rises by half of what the fullest window is over, so that few partitions are tried.
    """
    k = max(1, -(-sum(sizes) // capacity))
    while sizes:
        made = differencing(sizes, k)
        fullest = max(sum(sizes[i] for i in w) for w in made)
        if fullest <= capacity:
            return made
        k += max(1, k * (fullest - capacity) // (2 * capacity))
    return []


def packed(
    docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, capacity: int = 4096, with_ids: bool = False
) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens[, ids], sequence_id, offset): where each piece goes."""
    made = durable(
        pieces(docs, tokenizer or default_tokenizer(), end_id, capacity, with_ids).withColumn(
            "row", F.monotonically_increasing_id()
        )
    )
    count = max(1, -(-made.count() // SHARD))
    shape = "row long, sequence_id long, offset long"

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "row"], ascending=False, kind="stable")
        rows = rows.reset_index(drop=True)
        full = int((rows["length"] >= capacity).sum())
        sizes = rows["length"].tolist()
        plan = [[i] for i in range(full)] + [[full + i for i in w] for w in windows(sizes[full:], capacity)]
        base = int(rows["shard"].iloc[0]) << 32
        out = []
        for n, window in enumerate(plan):
            at = 0
            for i in window:
                out.append((rows["row"][i], base + n, at))
                at += sizes[i]
        return pd.DataFrame(out, columns=["row", "sequence_id", "offset"])

    keyed = made.select("row", "doc_id", "start", "length", F.pmod(F.xxhash64("row"), F.lit(count)).alias("shard"))
    # dealt evenly by number, since adaptive execution would join the small shards to a few tasks
    tasks = min(count, max(4 * docs.sparkSession.sparkContext.defaultParallelism, count // 64))
    placed = keyed.repartition(tasks, "shard").groupBy("shard").applyInPandas(pack, shape)
    return made.join(placed, "row").drop("row")
