"""Substring deduplication against all windows of all texts."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from rallyline.llm import passages

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
NAMES = "doc_id long, text string, row int, m long, same string, supers int, start int, z string"


def said(seed, n, kinds=5000):
    rng = random.Random(seed)
    return [f"w{rng.randrange(kinds)}" for _ in range(n)]


SHARED = said(1, 60)
ODD = [
    (1, " ".join(said(2, 80) + SHARED + said(3, 10))),
    (2, "\n ".join(SHARED + said(4, 50))),
    (3, " ".join(said(5, 34))),
    (4, " ".join(said(5, 34))),  # too short for a window
    (5, " ".join(said(6, 35))),
    (5, " ".join(said(6, 35))),
    (6, None),
    (7, ""),
    (8, " \t\x0b "),
    (9, "ab ab " * 300),  # repeats inside itself
    (10, "x y z " * 11 + "x"),  # 34 words
    (11, " ".join(said(7, 20) * 3)),
    (12, " ".join(["é\x1fß", "q" * 100_000, " "] + said(8, 40))),
    (13, " ".join(["é\x1fß", "q" * 100_000, " "] + said(8, 40) + ["q" * 100_001])),
    (None, " ".join(said(2, 80))),
    (14, " ".join(said(9, 40_000, 50))),
    (15, " ".join(SHARED[:35])),
    (16, " ".join(SHARED[:34] + ["other"])),
]


def brute(rows, window=35):
    lists = [(i, WORD.findall(t or "")) for i, t in rows]
    seen = Counter(tuple(w[k : k + window]) for _, w in lists for k in range(len(w) - window + 1))
    out = []
    for i, w in lists:
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def result(docs, window=35):
    rows = passages.removals(docs, window).collect()
    for r in rows:
        assert sum(s["end"] - s["begin"] for s in r["spans"]) == r["n_removed"]
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows), key=str)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1, 2, "s", 3, 4, "z") for r in ODD], NAMES).repartition(3)


def test_removals_of_odd_rows(odd):
    assert result(odd) == brute(ODD)
    assert result(odd, 5) == brute(ODD, 5)
    assert result(odd.where("false")) == []


def test_removals_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert result(docs) == brute(rows)


def test_crowded_buckets_give_the_same(odd, monkeypatch):
    monkeypatch.setattr(passages, "CROWD", 1)
    assert result(odd) == brute(ODD)


def test_texts_without_repeats(odd):
    rows = passages.without_repeats(odd.where("doc_id IN (2, 3, 9, 15)"))
    assert rows.columns == odd.columns
    got = {r["doc_id"]: r["text"] for r in rows.collect()}
    assert got == {2: " ".join(SHARED[35:] + said(4, 50)), 3: dict(ODD)[3], 9: "", 15: ""}


@pytest.mark.parametrize("window", [1, 2, 3, 8, 35, 200])
def test_super_kmers_cut_texts_into_their_windows(window):
    hashes = np.random.default_rng(window).integers(0, 2**64, 3000, dtype=np.uint64)
    hashes[1000:2000] = hashes[7]
    k, most = passages.shape_of(window)
    starts, sizes, minimisers, _ = passages.super_kmers(hashes, window)
    assert sizes.max() <= most and sizes.min() >= 1
    assert [s + j for s, n in zip(starts, sizes) for j in range(n)] == list(range(len(hashes) - window + 1))
    again = passages.super_kmers(hashes[500:900], window)
    by_window = dict(zip(np.repeat(starts, sizes) + np.concatenate([np.arange(n) for n in sizes]), np.repeat(minimisers, sizes)))
    for s, n, m in zip(*again[:3]):
        assert {by_window[500 + s + j] for j in range(n)} <= {m}
