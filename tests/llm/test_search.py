"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import pytest

from rallyline.llm import search

DATA = "/root/testdata/sf0.001"
TERM = re.compile(search.TERM)
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RNG = random.Random(3)
MANY = [(100 + i, " ".join(RNG.choice("abcdefghij") * RNG.randrange(1, 4) for _ in range(RNG.randrange(1, 60)))) for i in range(300)]
ODD = [
    (1, "The Cat, the cat-flap and THE hat"),
    (2, "the cat"),
    (2, "the cat"),
    (None, "the cat"),
    (3, None),
    (4, ""),
    (5, " ...!? \x00\x7f"),
    (6, "École école ÉCOLE straße cat 日本語 x y"),
    (7, "hat " * 50_000 + "cat"),
    (8, "hot " * 30),
    (9, "hot " * 30),
    *MANY,
]
ITEMS = [(0, "cat"), (1, "THE cat the HAT"), (1, "école 日本語"), (2, None), (3, "..."), (None, "hot aaa bb"), (4, "nowhere"), (5, "a b c d e f g h i j " * 30), (6, "hat straße École")]


def terms(text):
    return TERM.findall((text or "").translate(UP))


def brute(docs, items, k=10):
    own = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, length = sum(1 for _, _, n in own if n), sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in own:
            m = 25 + (75 * n * n_docs) // length if length else 0
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
                for t in terms(text)
                if c[t]
            )
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return Counter(out)


def result(docs, items, **more):
    rows = search.top_documents(search.indexed(docs, **more), items)
    return Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows.collect())


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1, "t", 2) for r in ODD], "doc_id long, text string, block int, terms string, q int").repartition(3)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(*r, 9, "x") for r in ITEMS], "item_id long, text string, rank int, doc_id string").repartition(2)


def test_search_of_odd_rows(odd, items):
    assert result(odd, items) == brute(ODD, ITEMS)


def test_small_blocks_groups_and_batches_give_the_same(odd, items, monkeypatch):
    for name, value in (("GROUP", 3), ("QUERIES", 2), ("TERMS", 5), ("FIRST", 1), ("BLOCK_TERMS", 20)):
        monkeypatch.setattr(search, name, value)
    assert result(odd, items, block=4) == brute(ODD, ITEMS)


def test_search_of_documents(spark):
    docs, items = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    rows, asked = ([tuple(r) for r in df.collect()] for df in (docs.select("doc_id", "text"), items.select("item_id", "text")))
    assert result(docs, items) == brute(rows, asked)


def test_empty_tables(odd, items):
    assert result(odd.where("false"), items) == result(odd, items.where("false")) == Counter()
    assert result(odd.where("doc_id = 3"), items) == Counter()


def test_blocks_that_cannot_matter_are_not_scored(spark, monkeypatch):
    """Blocks hold the highest parts of their documents, and only those over the threshold are opened."""
    rows = [(i, f"common w{i} w{i + 1}" if i % 97 else "common rare rare") for i in range(1, 2000)]
    index = search.indexed(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), block=10)
    blocks = [row for part in index.blocks.toArrow().to_batches() for row in search.rows_of(part)]
    assert sum(len(b["ids"]) for b in blocks) == len(rows) == index.documents
    for b in blocks[:20]:
        at = 0
        peaks = Counter()
        for size, end in zip(b["sizes"], b["ends"]):
            for t, n in zip(b["at"][at:end], b["times"][at:end]):
                m = 25 + 75 * size * index.documents // index.length
                peaks[b["terms"][t]] = max(peaks[b["terms"][t]], 10**9 * n // (1000 * n + 8 * m))
            at = end
        assert dict(zip(b["terms"], b["peaks"])) == dict(peaks)
    batch = search.Batch([[b"rare"]])
    batch.weigh(search.holders_of(index, batch), index.documents)
    bounds = [int(batch.bounds(b["terms"], b["peaks"])[0]) for b in blocks]
    assert sum(x > 0 for x in bounds) == len([i for i, _ in rows if i % 97 == 0])
    opened = search.Block(b, batch, index.documents, index.length)
    exact = opened.scores(0).tolist()
    monkeypatch.setattr(search, "EXACT", 1)
    assert opened.scores(0).tolist() == exact
