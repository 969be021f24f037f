"""The filter audit against plain counting."""

import re
from collections import Counter
from itertools import permutations

import pytest

from rallyline.llm import audit

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i}" for i in range(30_000))
ODD = [
    (1, "short", "en", "x"),
    (2, LONG, "en", "x"),
    (3, LONG, "en", "x"),
    (3, LONG, "en", "x"),
    (None, LONG, "en", "x"),
    (4, None, None, "x"),
    (5, "", "", "x"),
    (6, "LOUD " * 200, "de", "x"),
    (7, "a 50% | $5 &c. " + "word " * 90, "de", "x"),
    (8, " ".join(f"É{i}" for i in range(99)) + "\x1fa\x0bb", "fr", "x"),
    (9, "  ", "fr", "x"),
    (10, "aa" * 50_000 + " " + "A" * 12_000, "fr", "x"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, 1), (6, 0, None), (None, 1, 1), (99, 1, 1), (7, 1, 0), (7, 1, 0)]


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    ids, cells, out = {}, Counter(), {}
    for i, text, _ in rows:
        if i is not None:
            ids.setdefault(text or "", []).append(i)
    for i, text, lang in rows:
        text = text or ""
        words = WORD.findall(text)
        fails = "".join(
            name
            for name, failed in (
                ("A", len(words) < 100),
                ("B", 100 * len(set(words)) < 80 * len(words)),
                ("C", 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text)),
                ("D", any(c in text for c in "#$%&*|")),
                ("E", i is not None and min(ids[text]) < i),
            )
            if failed
        )
        cells[lang or "", fails, i in good, i in toxic] += 1
    orders = ["".join(o) for o in permutations("ABCDE")]
    for part in {c[0] for c in cells}:
        first = Counter()  # removed over all orders
        for order in orders:
            for step, name in enumerate(order, 1):
                n = Counter()
                for (p, fails, is_good, is_toxic), k in cells.items():
                    if p != part:
                        continue
                    gone = any(x in fails for x in order[: step - 1])
                    n["kept"] += k * (not gone and name not in fails)
                    n["removed"] += k * (not gone and name in fails)
                    n["redundant"] += k * (gone and name in fails)
                    n["unique"] += k * (fails == name)
                    n["good"] += k * (not gone and name in fails and is_good)
                    n["toxic"] += k * (not gone and name in fails and is_toxic)
                first[name] += n["removed"]
                out[part, order, step] = [n[x] for x in ("kept", "removed", "redundant", "unique", "good", "toxic")]
        for order in orders:
            for step, name in enumerate(order, 1):
                out[part, order, step].append(first[name])
    return out


def result(docs, labels):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    rows = audit.audited(docs, labels).collect()
    found = {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def test_audit_of_odd_rows(spark, labels):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, part string").repartition(3)
    assert result(docs, labels) == brute([r[:3] for r in ODD], LABELS)


def test_audit_of_documents(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    assert result(docs, labels) == brute(rows, [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])


def test_empty_tables(spark, labels):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert audit.audited(docs, labels).count() == 0
    docs = spark.createDataFrame([(1, "x", None)], docs.schema)
    assert result(docs, labels.where("false")) == brute([(1, "x", None)], [])


def test_sums_invert_to_cells(spark):
    masks = [(m, "every") for m in range(32) for _ in range(m * m % 7)]
    rows = spark.createDataFrame([("p", m, c) for m, c in masks], "part string, mask int, class string")
    (got,) = audit.inverted(audit.parity_sums(rows)).collect()
    assert got["cells"] == [m * m % 7 for m in range(32)]
