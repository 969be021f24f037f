"""The payload archive and the live build over the synthetic season."""

import datetime as dt
import hashlib
import json
import shutil

import pytest

from league import GAMES, write_season
from rallyline.operators import rosters
from rallyline.plans import season as plan
from rallyline.plans.season import Derived
from rallyline.sources import archive, payloads
from rallyline.sources.warehouse import Warehouse
from rallyline.streaming import live

FETCHED = "season string, endpoint string, game int, sha256 string, fetched_at timestamp_ntz, http_status int"


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("archive") / "raw"
    write_season(root)
    return root


def at(hour):
    return dt.datetime(2024, 10, 1) + dt.timedelta(hours=hour)


def test_bodies_are_kept_once_and_restored(spark, root, tmp_path):
    made = archive.objects(spark, str(root))
    path = str(tmp_path / "bodies")
    archive.store(made, path)
    archive.store(made, path)
    bodies = spark.read.parquet(path)
    assert bodies.count() == made.select("sha256").distinct().count() == 12
    assert archive.damaged(bodies).count() == 0
    r = made.where("endpoint = 'Points' AND game = 1").first()
    assert r["object_path"] == f"S1/Points/{hashlib.sha256((root / 'S1/Points/1.json').read_bytes()).hexdigest()}.json.gz"
    index = made.select("season", "endpoint", "game", "sha256").selectExpr("*", "true AS current")
    back = archive.restored(index, bodies, "Points", payloads.SHOTS)
    direct = payloads.payloads(spark, str(root), "Points", payloads.SHOTS)
    key = lambda r: (r["season"], r["game"])
    assert sorted(back.collect(), key=key) == sorted(direct.collect(), key=key)
    with pytest.raises(Exception, match="no sound body"):
        archive.restored(index, bodies.limit(0), "Points", payloads.SHOTS).collect()


def test_versions_and_changes(spark):
    rows = [("S", "E", 1, s, at(h), 200) for h, s in enumerate(["a", "b", "b", "a"])] + [("S", "E", 1, None, at(9), 404), ("S", "E", 2, "c", at(0), 200)]
    seen = spark.createDataFrame(rows, FETCHED)
    got = {(r["game"], r["sha256"]): (r["version"], r["current"]) for r in archive.versions(seen).collect()}
    assert got == {(1, "a"): (1, True), (1, "b"): (2, False), (2, "c"): (1, True)}
    changed = archive.content_changes(seen).where("game = 1").orderBy("fetched_at").collect()
    assert [r["content_changed"] for r in changed] == [False, True, False, True]
    assert archive.observed(seen, seen).count() == len(rows) + 1 and archive.observed(seen, seen, True).count() == 2 * len(rows)


def test_the_index_merges_what_is_seen(spark, tmp_path):
    """Observations in any order and any batches give what all at once give, and a batch leaves other games' rows alone."""
    rows = [("S", e, g, f"{g % 3}{(h * g) % 4}", at(h), 200) for g in range(1, 6) for e in ("E", "F") for h in range(6)]
    rows += [("S", "E", 1, None, at(7), 404)]
    seen = spark.createDataFrame(rows, FETCHED)
    house = Warehouse.opened(spark, str(tmp_path))
    for hours in ((3, 4), (0, 1), (5, 2, 7)):
        house = archive.indexed(house, seen.where(seen.fetched_at.isin([at(h) for h in hours])))
    key = lambda df: sorted(str(sorted(r.asDict().items())) for r in df.collect())
    assert key(house.table("index")) == key(archive.versions(seen))
    before = {r["game"]: r["commit"] for r in house.games("index").collect()}
    house = archive.indexed(house, spark.createDataFrame([("S", "E", 2, "new", at(30), 200)], FETCHED))
    after = {r["game"]: r["commit"] for r in house.games("index").collect()}
    assert {g for g in before if before[g] != after[g]} == {2} and house.table("index").where("game = 2 AND current AND sha256 = 'new'").count() == 1
    whole = key(house.table("index"))
    house = house.compacted("index")
    assert key(house.table("index")) == whole and house.games("index").select("commit").distinct().count() == 1


def test_metadata_is_compared_both_ways(spark):
    names = "season string, endpoint string, game int, sha256 string, byte_size long"
    a = spark.createDataFrame([("S", "E", 1, "x", 5), ("S", "E", 2, "x", None), ("S", "E", 3, "x", 5), ("S", "E", 5, None, None)], names)
    b = spark.createDataFrame([("S", "E", 1, "x", 5), ("S", "E", 2, "x", 5), ("S", "E", 4, "x", 5), ("S", "E", 5, None, None)], names)
    got = {(r["game"], r["finding"]) for r in archive.metadata_differences(a, b, ["sha256", "byte_size"]).collect()}
    assert got == {(2, "changed"), (3, "missing"), (4, "extra")}


def test_completeness(spark, root):
    games = payloads.games(spark, str(root), "S1")
    listing = payloads.inventory(spark, str(root))
    assert archive.incomplete(games, listing, live.ENDPOINTS).count() == 0
    less = listing.where("NOT (endpoint = 'Points' AND game = 2)")
    assert [(r["endpoint"], r["game"], r["finding"]) for r in archive.incomplete(games, less, live.ENDPOINTS).collect()] == [("Points", 2, "missing")]
    again = archive.incomplete(games.unionByName(games), listing, live.ENDPOINTS).collect()
    assert {(r["game"], r["finding"]) for r in again} == {(g, "repeated") for g in GAMES}


def test_live_builds_only_new_games(spark, root, tmp_path):
    raw, out, state = tmp_path / "raw", str(tmp_path / "out"), str(tmp_path / "state")
    shutil.copytree(root, raw)
    late = raw / "S1" / "Boxscore" / "4.json"
    body = late.read_text()
    late.unlink()

    def run():
        live.follow(spark, str(raw), out, state).awaitTermination()
        return {(r["game"], r["excluded"]) for r in Derived.load(spark, out).verdicts.collect()}

    assert run() == {(1, False), (2, True), (3, False)}
    first = {tuple(r) for r in Derived.load(spark, out).possessions.collect()}
    late.write_text(body)
    assert json.loads(body)["Stats"] and run() == {(1, False), (2, True), (3, False), (4, True)}
    got = Derived.load(spark, out)
    assert first < {tuple(r) for r in got.possessions.collect()}
    assert got.dimension_players.count() == got.dimension_players.select("player_id").distinct().count() == 24
    assert live.build(spark, str(raw), "S1", out).count() == 0


def rows_by_table(spark, out):
    tables = Derived.load(spark, out)
    return {name: sorted((str(sorted(r.asDict(recursive=True).items())) for r in getattr(tables, name).collect())) for name in Derived.names()}


def test_a_build_reads_its_own_games_and_a_turned_switch_remakes_little(spark, tmp_path):
    """Game 3 comes last and turns the switch: the others' files aren't opened, their minutes and verdicts are remade, and
    all is as one pass over the season has it."""
    raw, one, many = tmp_path / "raw", str(tmp_path / "one"), str(tmp_path / "many")
    write_season(raw)
    # a substitution stamped at the overtime's tip, and official minutes that only the corrected clock gives
    pbp = raw / "S1" / "PlaybyPlay" / "3.json"
    body = json.loads(pbp.read_text())
    for r in [r for r in body["ExtraTime"] if r["PLAYTYPE"].strip() in ("IN", "OUT")][:2]:
        r["MARKERTIME"] = "05:00"
    pbp.write_text(json.dumps(body))
    s = plan.Season.read(spark, str(raw), "S1", [3])
    events = rosters.corrected(rosters.timed(s.events))
    made = plan.seconds(s, rosters.transitions(events, s.players), rosters.lengths(events))
    moved = {r["player_id"]: r["seconds_candidate"] for r in made.where("seconds_candidate <> seconds_raw").collect()}
    box = raw / "S1" / "Boxscore" / "3.json"
    body = json.loads(box.read_text())
    players = [p for side in body["Stats"] for p in side["PlayersStats"] if p["Player_ID"].strip() in moved]
    for p in players:
        n = moved[p["Player_ID"].strip()]
        p["Minutes"] = f"{n // 60:02d}:{n % 60:02d}"
    assert len(players) == len(moved) > 0
    box.write_text(json.dumps(body))
    texts = {f: f.read_text() for e in live.ENDPOINTS for f in (raw / "S1" / e).iterdir()}
    late = [f for f in texts if f.name == "3.json"]
    for f in late:
        f.unlink()
    switch = lambda: {r[0] for r in Derived.load(spark, many).minutes.select("use_correction").distinct().collect()}
    live.build(spark, str(raw), "S1", many)
    assert switch() == {False}
    before = Warehouse.opened(spark, many)
    for f, text in texts.items():
        f.write_text(text if f in late else "{ this is no payload")
    assert [r["game"] for r in live.build(spark, str(raw), "S1", many).collect()] == [3] and switch() == {True}
    for f, text in texts.items():
        f.write_text(text)
    live.build(spark, str(raw), "S1", one)
    got, expected = rows_by_table(spark, many), rows_by_table(spark, one)
    for name in Derived.names():
        assert got[name] == expected[name], name
    # what doesn't depend on the switch lies where it lay
    after = Warehouse.opened(spark, many)
    for name in ("events", "minutes", "verdicts"):
        where = [{r["game"]: r["commit"] for r in house.games(name).where("game <> 3").collect()} for house in (before, after)]
        assert (where[0] == where[1]) == (name == "events")
