"""Joins that enrich must keep each row once, and identifiers must stand for one unit: else nothing is published."""

import pytest
from pyspark.sql import functions as F
from test_season import league  # noqa: F401

from rallyline.operators import quality, rosters
from rallyline.operators.quality import Violation
from rallyline.plans import season as plan
from rallyline.sources.warehouse import Warehouse


def test_a_join_that_repeats_rows_is_seen_by_its_own_job(spark):
    left = spark.range(100).withColumnRenamed("id", "k")
    for right, fails in ((spark.range(50).selectExpr("id AS k", "1 AS v"), False), (spark.range(50).selectExpr("id % 49 AS k", "1 AS v"), True)):
        watch = quality.JoinWatch()
        rows = watch.left(left, right, ["k"], "rows and values").groupBy("v").count()
        assert rows.count() == 2
        if fails:
            with pytest.raises(Violation, match="rows and values: 100 rows became 101"):
                watch.check()
        else:
            watch.check()


def test_a_doubled_side_fails_the_load_and_shared_identifiers_refuse_their_games(spark, league, tmp_path, monkeypatch):  # noqa: F811
    _, _, s, d = league
    real = rosters.off_court
    monkeypatch.setattr(rosters, "off_court", lambda *a: real(*a).unionByName(real(*a)))
    one = d.stints.where("game = 1").orderBy("stint").first()["lineup_away"]
    users = {r["game"] for r in d.stints.where((F.col("lineup_home") == one) | (F.col("lineup_away") == one)).select("game").collect()}
    known = d.lineups.where(F.col("lineup_id") == one).withColumn("team", F.lit("ZZZ"))
    refused = []
    made = plan.derive(s, refused, known=known)
    assert {(r["game"], r["finding"]) for bad in refused for r in bad.collect()} == {(g, "lineup_collision") for g in users}
    assert {r["game"] for r in made.verdicts.select("game").collect()} == {1, 2, 3, 4} - users
    with pytest.raises(Violation, match="events and suspects: .* rows became"):
        made.save(str(tmp_path))
    assert Warehouse.opened(spark, str(tmp_path)).version == 0
