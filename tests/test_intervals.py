"""Sweeps over intervals against trying every pair."""

import random
from collections import Counter

import pytest

from rallyline.operators import intervals

KEYS = ("season", "game")


def rows_of(seed, n, open_ends=True):
    rng = random.Random(seed)
    points = [("S", g, rng.randrange(40) if rng.random() > 0.05 else None, f"q{i}") for g in (1, 2, None) for i in range(n)]
    spans = []
    for g in (1, 2, None, 4):
        for i in range(n):
            a = rng.randrange(-5, 40)
            b = None if open_ends and rng.random() < 0.2 else a + rng.randrange(-1, 15)
            spans.append(("S", g, f"p{i % 7}", a if rng.random() > 0.05 else None, b))
    return points, spans + spans[:3]


@pytest.mark.parametrize("closed", [True, False])
def test_covering_is_every_pair(spark, closed):
    for seed, n in ((1, 30), (2, 3), (3, 0)):
        points, spans = rows_of(seed, n)
        p = spark.createDataFrame(points, "season string, game int, pos int, name string").repartition(3)
        s = spark.createDataFrame(spans, "season string, game int, who string, start int, end int")
        got = intervals.covering(p, s, KEYS, "pos", closed=closed)
        assert got.columns == [*p.columns, "who", "start", "end"]
        expected = Counter(
            (*q, *x[2:])
            for q in points
            for x in spans
            if q[:2] == x[:2] and q[2] is not None and x[3] is not None and x[3] <= q[2] and (x[4] is None or q[2] < x[4] + closed)
        )
        assert Counter(tuple(r) for r in got.collect()) == expected


def test_covering_has_no_range_filter(spark):
    """Half a million pairs that overlap nothing cost nothing: the join is on equality alone."""
    p = spark.range(50_000).selectExpr("'S' AS season", "1 AS game", "cast(2 * id AS int) AS pos")
    s = spark.range(50_000).selectExpr("'S' AS season", "1 AS game", "cast(2 * id + 1 AS int) AS start", "cast(2 * id + 2 AS int) AS end")
    got = intervals.covering(p, s, KEYS, "pos")
    assert got.where("pos <> end").isEmpty() and got.count() == 49_999


def test_latest_begun(spark):
    points, spans = rows_of(5, 12)
    points, spans = [q for q in points if q[2] is not None], [x for x in spans if x[3] is not None]
    p = spark.createDataFrame(points, "season string, game int, pos int, name string")
    s = spark.createDataFrame(spans, "season string, game int, who string, start int, end int")
    for r in intervals.latest_begun(p, s, KEYS, "pos", "start", "span").collect():
        begun = [x for x in spans if x[1] == r["game"] and x[3] <= r["pos"]]
        assert (r["span"] is None) == (not begun)
        if begun:
            assert r["span"]["start"] == max(x[3] for x in begun) and tuple(r["span"]) in {x[2:] for x in begun}


def test_merged_counts_equal_spans_once_each(spark):
    """Equal spans leave an order open: both windows of `merged` read one sort, so every order gives the same rows."""
    rng = random.Random(9)
    spans = [("S", g, a, a + 6) for g in (1, 2, None) for a in rng.choices(range(0, 300, 5), k=60)] + [("S", 1, None, None)] * 2
    expected = []
    for g in (1, 2, None):
        reach = None
        for _, _, a, b in sorted(x for x in spans if x[1] == g and x[2] is not None):
            if reach is None or a > reach:
                expected.append(["S", g, a, b, 0])
            reach = expected[-1][3] = max(expected[-1][3], b)
            expected[-1][4] += 1
    expected = Counter(map(tuple, [*expected, *[["S", 1, None, None, 1]] * 2]))
    for seed in range(3):
        rng.shuffle(spans)
        df = spark.createDataFrame(spans, "season string, game int, start int, end int").repartition(2 + seed)
        assert Counter(tuple(r) for r in intervals.merged(df, KEYS).select(*KEYS, "start", "end", "parts").collect()) == expected
