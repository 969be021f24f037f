"""Small rules by themselves: geometry, clocks, settlement, fingerprints, keys."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rallyline.functions import scalars
from rallyline.operators import quality
from rallyline.sources import payloads
from rallyline.streaming import settlement


def test_geometry(spark):
    points = [(660, 0), (-660, 100), (660, 200), (0, 675), (659, 0), (-700, -141), (700, 143)]
    df = spark.createDataFrame(points, "x int, y int")
    got = df.select("x", "y", scalars.corner_three(F.col("x"), F.col("y")).alias("c"), scalars.squared_distance(F.col("x"), F.col("y")).alias("d")).collect()
    for r in got:
        assert r["c"] == (abs(r["x"]) >= 660 and r["y"] ** 2 <= 675**2 - 660**2) and r["d"] == r["x"] ** 2 + r["y"] ** 2


def test_strict_booleans_and_official_minutes(spark):
    df = spark.createDataFrame([("1",), ("TRUE",), ("0",), ("false",)], "t string")
    assert [r[0] for r in df.select(scalars.strict_boolean(F.col("t"))).collect()] == [True, True, False, False]
    for junk in ("yes", "", None):
        with pytest.raises(Exception, match="not a boolean"):
            spark.createDataFrame([(junk,)], "t string").select(scalars.strict_boolean(F.col("t"))).collect()
    df = spark.createDataFrame([("12:34",), ("DNP",), ("dnp ",), (None,), (" ",), ("x:1",), ("40:00",)], "t string")
    assert [r[0] for r in df.select(scalars.official_seconds(F.col("t"))).collect()] == [754, None, None, None, None, None, 2400]


def test_referee_pairs(spark):
    df = spark.createDataFrame([("A, B, C, D",), ("A , B",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(payloads.referee_pairs(F.col("t"))).collect()] == [["A, B", "C, D"], ["A, B"], [], []]
    with pytest.raises(Exception, match="pairs"):
        spark.createDataFrame([("A, B, C",)], "t string").select(payloads.referee_pairs(F.col("t"))).collect()


def test_settlement(spark):
    at = lambda d, h=0: datetime(2024, 1, d, h)
    seen = [(1, at(1), "a"), (1, at(1, 7), "a"), (2, at(1), "a"), (2, at(9), "b"), (3, at(2), "c"), (3, at(2, 1), "d"), (3, at(2, 2), "c"), (4, at(3), "e")]
    fetches = spark.createDataFrame(seen, "game int, fetched_at timestamp_ntz, sha256 string")
    now = F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")
    owed = settlement.owed(fetches, now, 2).collect()
    # the oldest owed mark of each game, games by first fetch; game 2 was read after all its marks
    assert [(r["game"], r["label"]) for r in owed] == [(1, "+24h"), (3, "+6h")]
    assert [r["game"] for r in settlement.owed(fetches, now, 9).collect()] == [1, 3, 4]
    hours = fetches.where("game = 1").select(settlement.elapsed_hours(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("fetched_at"))).collect()
    assert sorted(r[0] for r in hours) == [0.0, 7.0]
    assert [r["game"] for r in settlement.changed_games(fetches).collect()] == [2, 3]


def test_table_fingerprints(spark):
    rows = [(1, "a"), (2, "b"), (2, "b")]
    a, b = (spark.createDataFrame(x, "k int, v string") for x in (rows, rows[::-1]))
    one, same = quality.table_fingerprint(a), quality.table_fingerprint(b.select("v", "k").repartition(3))
    assert one == same and one[0] == 3 and quality.table_fingerprint(a.limit(0)) == (0, 0, 0)
    other = quality.table_fingerprint(a.withColumn("v", F.lit("c")))
    assert quality.fingerprint_changes({"t": one, "u": one, "w": one}, {"t": same, "u": other, "x": one}) == ["u", "w", "x"]
    small = spark.createDataFrame([(i, f"v{i}") for i in (*range(40), 9000, 2**25, 2**40)], "k long, v string")
    by_ranges = {quality.ordered_fingerprint(small.repartition(n), F.col("v"), "k").first() for n in (1, 4)}
    assert len(by_ranges) == 1 and by_ranges.pop()["n"] == 43


def test_one_to_one(spark):
    a, b = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(1, "x"), (2, "y")], "k int, w string")
    assert {tuple(r) for r in quality.one_to_one(a, b, ["k"]).collect()} == {(1, "a", "x"), (2, "b", "y")}
    for bad, what in ((b.unionByName(b.limit(1)), "repeated"), (b.where("k = 1"), "one side"), (b.withColumn("k", F.col("k") + 1), "one side")):
        with pytest.raises(quality.Violation, match=what):
            quality.one_to_one(a, bad, ["k"])
    with pytest.raises(quality.Violation):
        quality.refuse(a, "rows")


def test_net_ratings_round_once(spark):
    df = spark.createDataFrame([(1, 3, 2, 3), (5, 0, 1, 2), (100, 7, 93, 11)], "p long, n long, a long, m long")
    got = [r[0] for r in df.select(scalars.net_rate(F.col("p"), F.col("n"), F.col("a"), F.col("m"))).collect()]
    assert [None if x is None else float(x) for x in got] == [-33.33, None, 583.12]
