"""The gate is empty for a sound season and names each thing that is broken; loads refuse what they must."""

import pytest
from pyspark.sql import functions as F
from test_season import league  # noqa: F401

from rallyline.operators.quality import Violation
from rallyline.plans import gate, guards
from rallyline.plans.season import Derived, Season
from rallyline.sources import archive, payloads
from rallyline.streaming import live


def changed(tables, **new):
    return type(tables)(**({name: getattr(tables, name) for name in tables.names()} | new))


def test_a_sound_season_passes(league):  # noqa: F811
    _, _, s, d = league
    assert gate.violations(s, d).collect() == []
    assert gate.hashes(s.games.select(F.sha2(F.col("game").cast("string"), 256).alias("sha256"))).count() == 0
    assert 0 < gate.lineup_collisions(d) < 1e-30


def test_each_broken_table_is_named(league):  # noqa: F811
    _, _, s, d = league
    one = "season = 'S1' AND game = 1"
    cases = {
        "events_of_a_game": (s, changed(d, events=d.events.where("NOT (game = 1 AND pos = 3)"))),
        "event_changed": (s, changed(d, events=d.events.withColumn("clock", F.when(F.expr(one) & (F.col("pos") == 3), "09:99").otherwise(F.col("clock"))))),
        "games_and_verdicts": (s, changed(d, verdicts=d.verdicts.where(f"NOT ({one})"))),
        "shots_of_a_game": (changed(s, shots=s.shots.where("NOT (game = 1 AND number % 2 = 0)")), d),
        "verdict": (s, changed(d, verdicts=d.verdicts.withColumn("excluded", F.col("excluded") | F.expr(one)))),
        "possession_of_other_units": (s, changed(d, possessions=d.possessions.withColumn("offense_lineup", F.when(F.expr(one) & (F.col("possession_index") == 0), "x").otherwise(F.col("offense_lineup"))))),
        "stint_gap": (s, changed(d, stints=d.stints.where(f"NOT ({one} AND stint = 1)"))),
        "team_minutes": (s, changed(d, minutes=d.minutes.withColumn("seconds_corrected", F.col("seconds_corrected") + F.expr(one).cast("int")))),
    }
    for name, (season, derived) in cases.items():
        found = {(r["gate"], r["game"]) for r in gate.violations(season, derived).collect()}
        assert (name, 1) in found and all(g == 1 for _, g in found), (name, found)
    # a feed that was never loaded is no violation
    assert gate.violations(changed(s, shots=s.shots.where("game <> 1")), d).count() == 0


def test_guards(spark, league, tmp_path):  # noqa: F811
    _, _, s, d = league
    flat, out = str(tmp_path / "flat"), str(tmp_path / "out")
    guards.load(s, flat, out)
    assert Season.load(spark, flat).events.count() == s.events.count()
    with pytest.raises(Violation, match="other games"):
        guards.load(changed(s, games=s.games.where("game <> 2")), flat, out)
    with pytest.raises(Violation, match="mixed"):
        guards.one_season(s.games.select("season").unionByName(s.games.select(F.lit("S2").alias("season"))))
    d.save(out)
    with pytest.raises(Violation, match="derived tables rest"):
        guards.load(s, flat, out)
    with pytest.raises(Violation, match="holds games already"):
        guards.build_whole(s, out)
    assert Derived.load(spark, out).verdicts.count() == 4


def test_archive_and_restore_a_season(spark, league, tmp_path):  # noqa: F811
    root, *_ = league
    path, out = str(tmp_path / "bodies"), str(tmp_path / "back")
    made = archive.archive_season(spark, str(root), "S1", path, sample=1)
    assert made.count() == 12
    seen = made.select("season", "endpoint", "game", "sha256", F.lit("2024-10-10").cast("timestamp").alias("fetched_at"), F.lit(200).alias("http_status"))
    index, games = archive.versions(seen), payloads.games(spark, str(root), "S1")
    archive.restore_season(index, spark.read.parquet(path), games, "S1", out, live.ENDPOINTS)
    before = archive.restored_season(spark, out, "S1")
    assert before.count() == 12 and archive.restored_season(spark, out, "S2") is None
    with pytest.raises(Violation, match="isn't whole"):
        archive.restore_season(index.where("NOT (game = 2 AND endpoint = 'Points')"), spark.read.parquet(path), games, "S1", out, live.ENDPOINTS)
    with pytest.raises(OSError, match="lost"), pytest.MonkeyPatch.context() as patch:
        patch.setattr(archive, "put", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
        archive.restore_season(index, spark.read.parquet(path), games, "S1", out, live.ENDPOINTS)
    # neither a season that isn't whole nor a run that breaks off changes what is there
    assert sorted(archive.restored_season(spark, out, "S1").collect()) == sorted(before.collect())
    archive.restore_season(index, spark.read.parquet(path), games, "S1", out, live.ENDPOINTS)
    assert archive.restored_season(spark, out, "S1").count() == 12
    assert archive.restored_season(spark, out, "S1").inputFiles() != before.inputFiles()
