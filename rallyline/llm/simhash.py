"""Near-duplicate detection by SimHash fingerprints and BK-trees.

A fingerprint has a bit for each hash bit that is set in over half of the shingles' hashes.  Fingerprints that may be
within the radius meet in a shard; each shard builds a BK-tree (children keyed by their Hamming distance to the parent)
and a search follows only the edges between distance - radius and distance + radius.  A tree over all fingerprints
would grow with the corpus, so none is broadcast whole: a shard's tree goes to the queries that can match in it.

Defined results: null text counts as empty; a text without words has fingerprint zero and links like any other; a text
with fewer words than a shingle has one shingle, all its words; repeated rows are returned each, under one component;
a null doc_id never becomes a component_id unless all ids of the component are null; an empty table gives no rows;
other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyline.llm.common import ROW, ROW_TYPE, components, durable, numbered, settled

SEED = 42
#: Odd multipliers that derive further independent hash words from a shingle's hash; fixed values.
MIXERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: Members of one shard that go through a tree of single nodes, see link_runs.
RUN = 64


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """XXH64 of every run of `width` words, repeats included, of the text with A-Z lower-cased."""
    words = (text or b"").lower().split()  # bytes.split() cuts at U+0020 and U+0009 to U+000D alone
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)),
        np.uint64,
        len(starts),
    )


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set, lowest bit first."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):
        part = np.ascontiguousarray(hashes[k : k + 4096]).view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return total


def majority(counts: np.ndarray, n: int) -> int:
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def signed(word: int) -> int:
    return word - (1 << 64) if word >> 63 else word


def fingerprints(docs: DataFrame, width: int = 3, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows (doc_id, fp): the 64-bit fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1):
                hashes = shingle_hashes(text.as_py(), width)
                out.append(signed(majority(bit_counts(hashes), len(hashes))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Fingerprints as integers; a node is (fingerprint, children by distance)."""

    def __init__(self) -> None:
        self.root: tuple[int, dict] | None = None

    def near(self, x: int, radius: int) -> list[int]:
        found, stack = [], [self.root] if self.root else []
        while stack:
            value, children = stack.pop()
            d = (value ^ x).bit_count()
            if d <= radius:
                found.append(value)
            stack.extend(children[e] for e in children if d - radius <= e <= d + radius)
        return found

    def add(self, x: int) -> None:
        if self.root is None:
            self.root = (x, {})
            return
        node = self.root
        while d := (node[0] ^ x).bit_count():
            if d not in node[1]:
                node[1][d] = (x, {})
                return
            node = node[1][d]


def link_runs(values: list[int], radius: int, run: int) -> list[tuple[int, int]]:
    """Pairs of values within the radius that connect exactly the classes that all such pairs make.

    Up to `run` values go through one BK-tree, which finds all their links.  More go through link_wide, which passes
    over links inside a class, so that a large group of near copies doesn't cost all its pairs.
    """
    if len(values) > run:
        words = np.frombuffer(b"".join(x.to_bytes(WIDE // 8, "little") for x in values), np.uint64).reshape(-1, WIDE // 64)
        return [(values[a], values[b]) for a, b in link_wide(words, radius)]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links, tree = [], BKTree()
    for x in values:
        if x in parent:
            continue
        parent[x] = x
        for y in tree.near(x, radius):
            a, b = root(x), root(y)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((x, y))
        tree.add(x)
    return links


def link_wide(words: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links between the rows of `words` (64 bits a column), as pairs of row numbers.

    A row that is reached looks for its neighbours among all rows not yet reached, and nowhere else, so
    no class is cut.  Rows are in order of their distance to the root, the row next to the majority of all bits, as in
    the first level of a BK-tree: a search only reads those between distance - radius and distance + radius.
    """
    bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
    middle = np.packbits(2 * bits.sum(0, dtype=np.int64) > len(words), bitorder="little").view(np.uint64)
    far = np.bitwise_count(words ^ words[np.bitwise_count(words ^ middle).sum(1).argmin()]).sum(1).astype(np.int64)
    free = np.argsort(far, kind="stable")
    while len(free):
        reached, free = [int(free[0])], free[1:]
        while reached and len(free):
            x = reached.pop()
            a = np.searchsorted(far[free], far[x] - radius)
            b = np.searchsorted(far[free], far[x] + radius, "right")
            near = np.bitwise_count(words[free[a:b]] ^ words[x]).sum(1) <= radius
            found = free[a:b][near]
            if len(found):
                free = np.concatenate([free[:a], free[a:b][~near], free[b:]])
                reached.extend(found.tolist())
                yield from ((x, y) for y in found.tolist())


def shards(batches: Iterator[pa.RecordBatch], key: bool = False) -> Iterator[list]:
    """The columns after the first, for each run of equal values in the first that has two rows or more.

    With `key`, the first column's value stands before them.  A run's parts are put together once, when it ends.
    """
    held: list[list[np.ndarray]] = []

    def whole() -> Iterator[list]:
        if sum(len(part[0]) for part in held) > 1:
            cols = [np.concatenate(x) for x in zip(*held, strict=True)] if len(held) > 1 else held[0]
            yield [*cols[0][:key], *cols[1:]]

    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(cols[0]):
            continue
        bounds = [0, *(np.flatnonzero(cols[0][1:] != cols[0][:-1]) + 1).tolist(), len(cols[0])]
        for a, b in zip(bounds, bounds[1:], strict=False):
            if held and held[0][0][0] != cols[0][a]:
                yield from whole()
                held = []
            held.append([c[a:b] for c in cols])
    yield from whole()


def band_keys(fp: Column, radius: int, levels: int = 3) -> Column:
    """Shard keys: fingerprints within the radius share at least one (pigeonhole, `levels` times over).

    Of radius + 1 bands one must agree; of the remaining bits, cut again, one band must agree, and so on.  With radius 2
    and three levels a key fixes 44 bits of 64 at least, so no shard can hold more than 2^20 fingerprints, whatever the data.
    """

    def cut(bits: list[int]) -> list[list[int]]:
        n = radius + 1
        return [bits[len(bits) * i // n : len(bits) * (i + 1) // n] for i in range(n)]

    masks: list[int] = []

    def walk(free: list[int], fixed: int, level: int) -> None:
        if not level:
            masks.append(fixed)
            return
        for band in cut(free):
            walk([b for b in free if b not in band], fixed | sum(1 << b for b in band), level - 1)

    walk(list(range(64)), 0, levels)
    return F.array(*[F.xxhash64(F.lit(i), fp.bitwiseAND(F.lit(signed(m)).cast("long"))) for i, m in enumerate(masks)])


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Links (u, v) that join all distinct fingerprints `fp` within the radius of each other into their classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (fps,) in shards(batches):
            pairs = link_runs([int(x) & (2**64 - 1) for x in fps], radius, 1 << 20)
            if pairs:
                u, v = ([signed(x) for x in side] for side in zip(*pairs, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    keyed = prints.select(F.explode(band_keys(F.col("fp"), radius)).alias("key"), "fp")
    return keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "u long, v long")


def near_components(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """Rows (doc_id, fp, fingerprint, component_id): components under links of at most `radius` differing bits.

    component_id is the smallest doc_id that the links reach, the document itself included.  The links are exact: every
    pair of distinct fingerprints within the radius meets in some shard.
    """
    prints = durable(fingerprints(docs, width))
    distinct = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(distinct, radius))
    known = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    heads = known.groupBy("root").agg(F.min("first").alias("component_id"))
    named = durable(known.join(heads, "root").select("fp", "component_id"))
    return prints.join(named, "fp").select(
        "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


#: Wide fingerprints for similarity rather than a few bits: 256 bits, and the tables of cross-polytope keys.
WIDE, TABLES, DIGITS, AXES = 256, 48, 3, 64
#: Standard errors of a fingerprint's distance that the radius lies beyond the mean.
SPREAD = 2.5
#: Rows of a key that one shard holds, about; a key with more is parted into blocks, see blocks_of.
CROWD = 1 << 16
#: Bits of the filter that tells which keys may be crowded.
FILTER = 1 << 20
#: Parts of the hash space in which a set's shingles are counted, and the count from which a part is full.
PARTS, FULL = 256, 255


def wide_counts(hashes: np.ndarray) -> np.ndarray:
    """Margins of 256 bits: set minus unset, for the hash and three remixes of it."""
    parts = [hashes]
    for m in MIXERS:
        x = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(m)
        parts.append(x ^ (x >> np.uint64(29)))
    return np.concatenate([2 * bit_counts(x) - len(hashes) for x in parts])


def radius_for(similarity: float) -> int:
    """Differing bits of 256 that shingle sets of this Jaccard similarity have on average, and SPREAD errors more."""
    angle = np.arccos(min(1.0, 2 * similarity / (1 + similarity))) / np.pi
    return int(WIDE * angle + SPREAD * np.sqrt(WIDE * angle * (1 - angle)))


@functools.cache
def rotations() -> np.ndarray:
    return np.random.default_rng(7).standard_normal((WIDE, TABLES * DIGITS * AXES)).astype(np.float32)


def wide_prints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For sets of shingle hashes: bits (n, 32 bytes) and keys (n, TABLES).

    A key is a table's number and three digits; a digit is the largest of 64 rotated coordinates of the bits' margins.
    """
    margins = np.stack([wide_counts(x) for x in sets])
    scaled = margins / np.maximum(1.0, np.linalg.norm(margins, axis=1, keepdims=True))
    turned = (scaled.astype(np.float32) @ rotations()).reshape(len(sets), TABLES, DIGITS, AXES)
    axis = np.abs(turned).argmax(-1)
    code = 2 * axis + (np.take_along_axis(turned, axis[..., None], -1)[..., 0] > 0)
    keys = np.arange(TABLES)
    for digit in range(DIGITS):
        keys = keys * (2 * AXES) + code[:, :, digit]
    return np.packbits(margins > 0, axis=1, bitorder="little"), keys.astype(np.int64)


def part_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes lie in each part; two sets can't share more than the sum of the parts' lesser counts."""
    return np.minimum(np.bincount((hashes % np.uint64(PARTS)).astype(np.int64), minlength=PARTS), FULL).astype(np.uint8)


def may_be_similar(counts: np.ndarray, other: np.ndarray, similarity: float) -> np.ndarray:
    """Which rows of counts can have this Jaccard similarity with `other`; it never rules out one that has it."""
    shared = np.minimum(counts, other).sum(1, dtype=np.int64)
    union = counts.sum(1, dtype=np.int64) + other.sum(dtype=np.int64) - shared
    return (shared >= (similarity - 1e-12) * union) | (counts == FULL).any(1) | (other == FULL).any()


def similar_prints(texts: DataFrame, width: int) -> DataFrame:
    """Rows (row, doc_id, same, bits, counts, keys) from (row, doc_id, text); `same` is a digest of the set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                sets = [np.unique(shingle_hashes(t.as_py(), width)) for t in part.column(2)]
                bits, keys = wide_prints(sets)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:2], pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()),
                     pa.array([x.tobytes() for x in bits], pa.binary()),
                     pa.array([part_counts(x).tobytes() for x in sets], pa.binary()),
                     pa.array(list(keys), pa.list_(pa.int64()))],
                    ["row", "doc_id", "same", "bits", "counts", "keys"],
                )

    return texts.mapInArrow(run, f"row {ROW_TYPE}, doc_id long, same binary, bits binary, counts binary, keys array<long>")


def forest_links(keyed: DataFrame, radius: int) -> DataFrame:
    """Rows (key, u, v) from (key, bits, id): in each shard, links within the radius that make up its classes.

    A document that is within the radius of any other in its shard has a link.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, bits, ids in shards(batches, key=True):
            values = [int.from_bytes(x, "little") for x in bits]
            of: dict[int, list[int]] = {}
            for x, i in zip(values, ids.tolist(), strict=True):
                of.setdefault(x, []).append(i)
            pairs = [(of[x][0], of[y][0]) for x, y in link_runs(list(of), radius, RUN)]
            pairs.extend((same[0], i) for same in of.values() for i in same[1:])
            if pairs:
                u, v = (pa.array(side, pa.int64()) for side in zip(*pairs, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([int(key)] * len(pairs), pa.int64()), u, v], ["key", "u", "v"])

    return keyed.repartition("key").sortWithinPartitions("key", "bits").mapInArrow(run, "key long, u long, v long")


def cross_links(keyed: DataFrame, radius: int, similarity: float) -> DataFrame:
    """Rows (u, v) from (key, bits, counts, id, root): pairs in a shard within the radius whose roots differ.

    All such pairs but those that by their counts can't have the similarity.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bits, counts, ids, roots in shards(batches):
            names, n = np.unique(roots, return_counts=True)
            if len(names) == 1:
                continue
            words = np.frombuffer(b"".join(bits), np.uint64).reshape(-1, WIDE // 64)
            # the commonest root's members stand last and only answer
            order = np.argsort(roots == names[n.argmax()], kind="stable")
            words, ids, roots = words[order], ids[order], roots[order]
            counts = np.frombuffer(b"".join(counts), np.uint8).reshape(-1, PARTS)[order]
            for k in range(len(ids) - int(n.max())):
                near = np.bitwise_count(words[k + 1 :] ^ words[k]).sum(1) <= radius
                at = k + 1 + np.flatnonzero(near & (roots[k + 1 :] != roots[k]))
                found = ids[at[may_be_similar(counts[at], counts[k], similarity)]]
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), ids[k]), pa.int64()), pa.array(found, pa.int64())], ["u", "v"])

    return keyed.repartition("key").sortWithinPartitions("key", "bits").mapInArrow(run, "u long, v long")


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def verified(pairs: DataFrame, texts: DataFrame, named: DataFrame, width: int, similarity: float) -> DataFrame:
    """Those of the pairs (u, v) whose sets of shingles, by XXH64, have a Jaccard similarity of at least this.

    texts has rows (row, text), named (row, id) the ids that pairs are made of.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                sets = [np.unique(shingle_hashes(t.as_py(), width)).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])

    needed = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct().join(named.hint("merge"), "id")
    sets = durable(texts.join(needed.hint("merge"), "row").select("id", "text").mapInArrow(run, "id long, shingles array<long>"))
    left, right = (sets.select(F.col("id").alias(x), F.col("shingles").alias(f"of_{x}")) for x in "uv")
    both = F.size(F.array_intersect("of_u", "of_v"))
    least = F.lit(similarity - 1e-12) * (F.size("of_u") + F.size("of_v") - both)
    return pairs.join(left.hint("merge"), "u").join(right.hint("merge"), "v").where(both >= least).select("u", "v")


def parted(keyed: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows (key, bits, id) of keys that fit a shard, and of the others with m and block, or None if there are none.

    A filter of a fixed number of bits tells them apart; a key that it takes for a crowded one gets one block.
    """
    many = durable(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CROWD))
    if many.isEmpty():
        return keyed, None
    place = F.pmod(F.xxhash64("key"), F.lit(FILTER))
    marked = many.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, CAST(p % 64 AS INT)))").alias("w"))
    words = [0] * (FILTER // 64)
    for r in marked.collect():  # FILTER / 64 rows at most
        words[r["at"]] = r["w"]
    bit = F.call_function("shiftright", F.get(F.lit(words), F.shiftright(place, 6)), (place % 64).cast("int")).bitwiseAND(F.lit(1))
    m = many.select("key", F.ceil(F.col("n") / F.lit(CROWD)).alias("m"))
    crowded = keyed.where(bit == 1).join(m.hint("merge"), "key", "left").fillna(1, ["m"])
    return keyed.where(bit == 0), durable(crowded.withColumn("block", F.pmod(F.xxhash64("id"), F.col("m"))))


def blocks_of(crowded: DataFrame) -> DataFrame:
    """Shards of crowded keys: rows (key, bits, id), key standing for a key's block.

    One row of each key, its pivot, is in all of its blocks, so that what is near to it meets over blocks.
    """
    first = F.min_by(F.struct("bits", "id"), F.struct(F.xxhash64("id"), "id"))
    pivots = crowded.groupBy("key").agg(first.alias("p"), F.max("m").alias("m"))
    pivots = pivots.select("key", "p.bits", "p.id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("block"))
    rows = crowded.select("key", "bits", "id", "block").unionByName(pivots).dropDuplicates(["key", "block", "id"])
    return rows.select(F.xxhash64("key", "block").alias("key"), "bits", "id")


def open_blocks(crowded: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (key, id, root) of crowded keys with several roots, key standing for a key's block.

    The rows of a key's commonest root stay in their block; all others go to each of its blocks, so any two rows with
    different roots meet.
    """
    rows = crowded.select("key", "m", "block", "id").join(roots.hint("merge"), "id", "left")
    rows = durable(rows.withColumn("root", F.coalesce("root", "id")))
    sizes = rows.groupBy("key", "root").agg(F.count("*").alias("n"))
    common = sizes.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("common"), F.count("*").alias("roots")).where("roots > 1")
    rows = rows.join(common.hint("merge"), "key")
    each = F.when(F.col("root") == F.col("common"), F.array("block")).otherwise(F.sequence(F.lit(0).cast("long"), F.col("m") - 1))
    return rows.select("key", F.explode(each).alias("at"), "id", "root").select(F.xxhash64("key", "at").alias("key"), "id", "root")


def similar_links(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Rows (row, doc_id, id) for docs, which must be settled, and links (u, v) of the ids of similar rows.

    Rows are similar if their sets of `width`-word shingles have a Jaccard similarity of `similarity` or more.

    Candidates are pairs of 256-bit SimHash fingerprints that share a key in some table and lie within the radius of
    the similarity, see radius_for; each link is verified on the shingles.  First the links that make up each shard's
    classes are verified, then every candidate whose ends that left in different classes, unless counts of the
    shingles by parts of the hash space rule it out, which they do for no true one.  So the links' classes are
    those of all true candidates, while a group of near copies doesn't cost all its pairs.  Texts with equal sets of
    shingles link to one of them first, so that a shard holds no copies; a key with very many rows is parted
    into blocks, and then all its rows with different roots meet in the second step.
    """
    radius = radius_for(similarity)
    rows = numbered(docs).select(F.col(ROW).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    texts = rows.select("row", "text")
    # an id is given once, when its row is stored
    made = durable(similar_prints(rows, width).withColumn("id", F.monotonically_increasing_id()))
    named = durable(made.select("row", "doc_id", "id"))
    heads = durable(made.groupBy("same").agg(F.min("id").alias("head"), *[F.first(x).alias(x) for x in ("bits", "counts", "keys")]))
    copies = durable(made.join(heads.select("same", "head"), "same").where("id <> head").select("id", "head"))
    del made  # so that its files can go
    heads = heads.select(F.col("head").alias("id"), "bits", "counts", "keys")
    keyed, crowded = parted(heads.select(F.explode("keys").alias("key"), "bits", "id"))
    forest = durable(forest_links(keyed, radius))
    found = ordered(forest)
    if crowded is not None:
        found = found.unionByName(ordered(forest_links(blocks_of(crowded), radius))).distinct()
    tried = durable(found)
    links = durable(verified(tried, texts, named.drop("doc_id"), width, similarity))
    roots = components(links).select(F.col("node").alias("id"), "root")
    touched = forest.select("key", F.explode(F.array("u", "v")).alias("id")).distinct()
    touched = touched.join(roots.hint("merge"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    touched = durable(touched)
    mixed = touched.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    open_ids = touched.join(mixed.hint("merge"), "key", "left_semi")
    if crowded is not None:
        open_ids = open_ids.select("key", "id", "root").unionByName(open_blocks(crowded, roots))
    open_rows = open_ids.join(heads.drop("keys").hint("merge"), "id")
    cross = cross_links(open_rows.select("key", "bits", "counts", "id", "root"), radius, similarity)
    rest = durable(ordered(cross).join(tried.hint("merge"), ["u", "v"], "left_anti"))
    links = links.unionByName(verified(rest, texts, named.drop("doc_id"), width, similarity))
    links = links.unionByName(copies.select(F.col("id").alias("u"), F.col("head").alias("v")))
    return named, links


def near_dedup(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs without near copies: of each class of similar texts the row with the smallest doc_id stays.

    Rows are judged by their texts, not by their ids: a row that repeats a doc_id, or has none, is a row like any other.
    A null doc_id counts as the largest; of rows with one doc_id any one may stay, but the same each time.
    """
    docs = settled(docs)
    rows, links = similar_links(docs, width, similarity)
    members = components(links)
    roots = members.select(F.col("root").alias("node"), "root").distinct()
    classes = durable(members.unionByName(roots).withColumnRenamed("node", "id").join(rows.hint("merge"), "id"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    stays = durable(classes.groupBy("root").agg(F.min(order)["row"].alias("stays")))
    gone = classes.join(stays.hint("merge"), "root").where("row <> stays").select(F.col("row").alias(ROW))
    return numbered(docs).join(gone.hint("merge"), ROW, "left_anti").select(docs.columns)
