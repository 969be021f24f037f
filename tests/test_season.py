"""A synthetic season from payload files to derived tables and views."""

import pytest

from league import GAMES, write_season
from rallyline.operators import episodes
from rallyline.plans import season as plan
from rallyline.plans import views
from rallyline.sources import payloads


@pytest.fixture(scope="module")
def league(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("season") / "raw"
    facts = write_season(root)
    s = plan.Season.read(spark, str(root), "S1")
    s.save(f"{root.parent}/flat")
    s = plan.Season.load(spark, f"{root.parent}/flat")
    plan.derive(s).save(f"{root.parent}/derived")
    d = plan.Derived.load(spark, f"{root.parent}/derived")
    return root, facts, s, d


def test_events_keep_their_order(league):
    _, facts, s, _ = league
    for game, f in facts.items():
        rows = s.events.where(f"game = {game}").orderBy("pos").collect()
        flat = [(r["PLAYTYPE"].strip(), i + 1) for i, part in enumerate(f["lists"]) for r in part]
        assert [(r["playtype"], r["period"]) for r in rows] == flat


def test_unplayed_games_are_left_out(league):
    assert {r["game"] for r in league[2].games.collect()} == set(GAMES)


def test_minutes_agree_with_the_facts(league):
    _, facts, _, d = league
    got = {(r["game"], r["player_id"]): r["seconds_raw"] for r in d.minutes.collect()}
    for game, f in facts.items():
        for p, n in f["seconds"].items():
            wrong = 30 if game == 2 and p == f"P{f['home']}0" else 0
            assert got[game, p] == n - wrong


def test_verdicts(league):
    got = {r["game"]: (r["excluded"], r["reasons"]) for r in league[3].verdicts.collect()}
    assert got == {1: (False, []), 2: (True, ["minutes_mismatch"]), 3: (False, []), 4: (True, ["off_court_attribution"])}


def test_clock_rules_are_measured_together(league):
    """What each rule would leave wrong: the raw clock what the stored minutes count, no rule more here than another."""
    _, _, s, d = league
    got = {r["game"]: (r["raw"], r["tip_shift"]) for r in plan.clock_control(s).collect()}
    assert got == {r["game"]: (r["raw_wrong"], r["candidate_wrong"]) for r in d.sums.collect()}
    assert got[2] == (1, 1) and got[1] == (0, 0)


def test_points_reconcile(league):
    _, facts, s, d = league
    assert plan.point_differences(s).count() == 0
    points = {(r["game"], r["team"]): r["p"] for r in d.possessions.groupBy("game", "team").agg({"points": "sum"}).withColumnRenamed("sum(points)", "p").collect()}
    assert points == {(g, t): n for g, f in facts.items() for t, n in f["score"].items()}


def test_stints_cover_the_game(league):
    _, facts, _, d = league
    for game in facts:
        rows = d.stints.where(f"game = {game}").orderBy("stint").collect()
        assert [r["stint"] for r in rows] == list(range(len(rows)))
        assert all(len(r["unit_home"]) == len(r["unit_away"]) == 5 for r in rows)
        assert all(a["end_pos"] + 1 == b["start_pos"] and a["end_at"] == b["start_at"] for a, b in zip(rows, rows[1:], strict=False))
        assert rows[-1]["end_at"] == (2700 if game == 3 else 2400)
        assert sum(r["points_a"] for r in rows) == facts[game]["score"][facts[game]["home"]]


def test_possession_attachment(league):
    d = league[3]
    assert d.possessions.where("stint IS NULL OR offense_lineup IS NULL").count() == 0
    covered = d.events.where("possession_index IS NOT NULL").count()
    assert covered > 0.5 * d.events.count()
    assert d.events.groupBy("season", "game", "pos").count().where("count > 1").count() == 0


def test_incremental_is_the_single_pass(spark, league):
    _, _, s, d = league
    whole = {tuple(r) for r in d.possessions.collect()}
    columns = d.possessions.columns
    parts = set()
    for chosen in ((1, 4), (2, 3)):
        games = spark.createDataFrame([("S1", g) for g in chosen], "season string, game int")
        parts |= {tuple(r) for r in plan.derive(s.only(games)).possessions.select(columns).collect()}
    assert parts == whole


def test_views(league):
    _, facts, s, d = league
    games = {r["game"]: r for r in views.v_game(d).collect()}
    assert all(games[g]["winner"] == max(f["score"], key=f["score"].get) for g, f in facts.items() if len(set(f["score"].values())) == 2)
    teams = views.v_team_game(s, d).collect()
    assert len(teams) == 8 and all(r["points"] == facts[r["game"]]["score"][r["team"]] for r in teams)
    assert all(abs(r["possessions"] - r["opp_possessions"]) <= 2 for r in teams)
    assert views.v_player_game(s, d).count() == s.players.count()
    assert views.v_lineup_player(d).groupBy("lineup_id").count().where("count <> 5").count() == 0
    shots = views.v_shot_data(s, d)
    assert shots.count() == sum(r["PLAYTYPE"].strip() in ("2FGM", "3FGM", "2FGA", "FTM", "FTA") for f in facts.values() for part in f["lists"] for r in part)
    real = sum(x["COORD_X"] != -1 for f in facts.values() for x in f["shots"])
    assert shots.where("has_real_coordinate").count() == real
    assert views.v_play_by_play(d).count() == d.events.count() and views.v_possession(d).count() == d.possessions.count()


def test_inventory_and_hashes(spark, league):
    import hashlib
    import json

    root = league[0]
    rows = payloads.inventory(spark, str(root)).collect()
    assert len(rows) == 12
    r = rows[0]
    data = (root / r["season"] / r["endpoint"] / f"{r['game']}.json").read_bytes()
    assert r["sha256"] == hashlib.sha256(data).hexdigest() and r["byte_size"] == len(data)
    df = spark.createDataFrame([('{"b": 1, "a": {"d": 2, "c": "é"}}',), (None,)], "j string")
    got = [x[0] for x in df.select(payloads.canonical_sha256("j")).collect()]
    assert got == [hashlib.sha256('{"a":{"c":"é","d":2},"b":1}'.encode()).hexdigest(), None]
    assert json.loads('{"a": 1}')


def test_overtimes_split_at_the_end_of_a_period(spark):
    ev = lambda p: {"PLAYTYPE": p}
    extra = [ev(p) for p in ("BP", "2FGM", "EP", "EG", "BP", "TO", "EP", "EG")]
    df = spark.createDataFrame([("S", 1, None, None, None, None, extra)], f"season string, game int, {payloads.PLAY_BY_PLAY}")
    assert [r["period"] for r in payloads.events(df).orderBy("pos").collect()] == [5, 5, 5, 5, 6, 6, 6, 6]
    assert episodes.NO_BALL
