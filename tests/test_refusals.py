"""Games that break a rule are refused: one broken game for each rule, beside sound ones."""

import functools
import json

import pytest
from pyspark.sql import DataFrame

from league import write_season
from rallyline.operators.quality import Violation
from rallyline.plans import season as plan
from rallyline.sources.warehouse import Warehouse
from rallyline.streaming import live


def rows_of(body, play):
    return [r for part in body.values() for r in part or [] if r["PLAYTYPE"].strip() == play]


def falling_score(pbp, box):
    rows_of(pbp, "2FGM")[-1]["POINTS_A"] = 0


def unknown_play(pbp, box):
    rows_of(pbp, "TO")[0]["PLAYTYPE"] = "ZZ"


def third_team(pbp, box):
    rows_of(pbp, "TO")[0]["CODETEAM"] = "XXX"


def four_starters(pbp, box):
    box["Stats"][0]["PlayersStats"][0]["IsStarter"] = 0


def repeated_player(pbp, box):
    box["Stats"][0]["PlayersStats"].append(box["Stats"][0]["PlayersStats"][-1])


def lone_substitution(pbp, box):
    part = next(p for p in pbp.values() if p and any(r["PLAYTYPE"].strip() == "IN" for r in p))
    part.remove(next(r for r in part if r["PLAYTYPE"].strip() == "IN"))


def clockless_substitution(pbp, box):
    for play in ("IN", "OUT"):
        rows_of(pbp, play)[0]["MARKERTIME"] = ""


def sixth_player(pbp, box):
    out, comes = rows_of(pbp, "OUT")[0], rows_of(pbp, "IN")[0]
    team = out["CODETEAM"].strip()
    out["PLAYER_ID"] = next(f"P{team}{i}" for i in (7, 6, 5) if f"P{team}{i}" != comes["PLAYER_ID"].strip())


def wrong_points(pbp, box):
    box["Stats"][0]["PlayersStats"][0]["Points"] += 1


BROKEN = {
    "score_decreased": falling_score, "unknown_play": unknown_play, "third_team": third_team, "not_five_starters": four_starters,
    "repeated_player": repeated_player, "unpaired_substitutions": lone_substitution, "substitution_without_team_or_clock": clockless_substitution,
    "team_minutes": sixth_player, "points_do_not_reconcile": wrong_points,
}


@pytest.fixture(scope="module")
def broken(spark, tmp_path_factory):
    """One season for each rule, in one tree: game 1 of season B<n> breaks rule n, the others are sound."""
    root = tmp_path_factory.mktemp("broken") / "raw"
    for n, change in enumerate(BROKEN.values()):
        write_season(root, f"B{n}", seed=3)
        files = [root / f"B{n}" / e / "1.json" for e in ("PlaybyPlay", "Boxscore")]
        bodies = [json.loads(f.read_text()) for f in files]
        change(*bodies)
        for f, body in zip(files, bodies, strict=True):
            f.write_text(json.dumps(body))
    return root


def test_each_broken_game_is_refused_alone(spark, broken):
    seasons = [plan.Season.read(spark, str(broken), f"B{n}") for n in range(len(BROKEN))]
    # the payload tables of one read hold the whole tree; the schedule's are by season
    tables = {name: getattr(seasons[0], name) for name in plan.Season.names()}
    for name in ("games", "teams"):
        tables[name] = functools.reduce(DataFrame.unionByName, [getattr(s, name) for s in seasons])
    whole = plan.Season(**tables)
    refused = []
    made = plan.derive(whole, refused)
    got = {(r["season"], r["game"], r["finding"]) for bad in refused for r in bad.collect()}
    for n, finding in enumerate(BROKEN):
        assert (f"B{n}", 1, finding) in got
    assert {(s, g) for s, g, _ in got} == {(f"B{n}", 1) for n in range(len(BROKEN))}
    assert {(r["season"], r["game"]) for r in made.verdicts.collect()} == {(f"B{n}", g) for n in range(len(BROKEN)) for g in (2, 3, 4)}
    with pytest.raises(Violation, match="score_decreased"):
        plan.derive(seasons[0].only(whole.games.where("season = 'B0'").select("season", "game")))


def test_builds_leave_refused_games_out_and_name_them(spark, broken, tmp_path):
    out = str(tmp_path / "out")
    assert {r["game"] for r in live.build(spark, str(broken), "B1", out).collect()} == {2, 3, 4}
    assert [tuple(r) for r in Warehouse.opened(spark, out).table("refused").select("season", "game", "finding").collect()] == [("B1", 1, "unknown_play")]
    lacking = broken / "B2" / "Points" / "3.json"
    body = lacking.read_text()
    lacking.unlink()
    assert [tuple(r) for r in live.missing(spark, str(broken), "B2").collect()] == [("B2", 3, "Points")]
    with pytest.raises(Violation, match="payloads are missing"):
        live.build(spark, str(broken), "B2", str(tmp_path / "none"), partial=False)
    assert not (tmp_path / "none").exists()
    lacking.write_text(body)


def test_junk_in_the_box_score_is_an_error(spark, tmp_path):
    for n, (key, value, message) in enumerate((("IsStarter", "maybe", "not a boolean"), ("Team", " ", "is missing"))):
        root = tmp_path / f"raw{n}"
        write_season(root)
        f = root / "S1" / "Boxscore" / "1.json"
        body = json.loads(f.read_text())
        body["Stats"][0]["PlayersStats"][0][key] = value
        f.write_text(json.dumps(body))
        with pytest.raises(Exception, match=message):
            plan.Season.read(spark, str(root), "S1").players.collect()
