"""Trips and possessions against a plain sequential restatement of the rules, on random streams."""

import random

from rallyline.operators import episodes
from rallyline.operators.episodes import CONTINUING, ENDING, FIELD_GOALS, FOULS, FREE_THROWS, NO_BALL, RETAINING
from rallyline.operators.ordered import Stream

PLAYS = episodes.Plays(Stream(("game",), "pos"))
BALL = (*ENDING, *CONTINUING)


def random_games(seed: int, games: int):
    rng = random.Random(seed)
    rows = []
    codes = [*BALL, *FREE_THROWS * 4, *FOULS, *RETAINING, *NO_BALL[:3], "2FGM"]
    for game in range(games):
        for pos in range(60):
            play = rng.choice(codes)
            if pos and rng.random() < 0.35 and rows[-1][2] in (*FREE_THROWS, *FIELD_GOALS, *RETAINING):
                play = rng.choice(FREE_THROWS)
                team, player = (rows[-1][3], rows[-1][4]) if rng.random() < 0.8 else (rng.choice("HA"), rng.choice("xy"))
            else:
                team, player = rng.choice("HA"), rng.choice("xy")
            rows.append((game, pos, play, team, player, 1 + pos // 20, "H", "A"))
    return rows


def sequential_trips(rows):
    """{pos: (trip, position, size, and_one, excluded)} of one game."""
    found, trips, current, ball, since, prev = {}, [], None, None, [], None
    for r in rows:
        pos, play, team, player = r[1:5]
        if play in FREE_THROWS:
            if current is None or prev is None or current["player"] != player:
                current = {"player": player, "shots": [], "and_one": bool(ball) and ball[0] in FIELD_GOALS and ball[1:] == (team, player),
                           "retained": any(f in RETAINING for f in since)}
                trips.append(current)
            current["shots"].append(pos)
        if play in BALL or play in FOULS:
            prev = play in FREE_THROWS or None
            if not prev:
                current = None
        if play in BALL:
            ball, since = (play, team, player), []
        elif play in FOULS:
            since.append(play)
    for n, t in enumerate(trips, 1):
        for k, pos in enumerate(t["shots"], 1):
            found[pos] = (n, k, len(t["shots"]), t["and_one"], t["and_one"] or t["retained"])
    return found


def sequential_possessions(rows):
    trips = sequential_trips(rows)
    open_, closed, off, after_out, last = {}, [], {}, False, None

    def close(team, end, reason):
        p = open_.pop(team)
        p |= {"end": end, "reason": reason}
        closed.append(p)

    def begin(team, pos, period):
        open_.setdefault(team, {"team": team, "start": pos, "points": 0, "period": period})

    for r in rows:
        _, pos, play, team, _, period, home, away = r
        if last and last[5] != period:
            for t in (home, away):
                if t in open_:
                    close(t, last[1], "end_of_period")
        last = r
        if play not in BALL:
            continue
        if play in FREE_THROWS and trips[pos][4]:
            after_out = True
            if play == "FTM":
                if trips[pos][3]:
                    mine = [p for p in closed if p["team"] == team]
                    (mine[-1] if mine else open_[team])["points"] += 1
                else:
                    off[team] = off.get(team, 0) + 1
            continue
        if play in FREE_THROWS:
            begin(team, pos, period)
            if play == "FTM":
                open_[team]["points"] += 1
                if trips[pos][1] == trips[pos][2]:
                    close(team, pos, "made_free_throw")
        elif play == "D":
            if not after_out:
                other = away if team == home else home
                begin(other, pos, period)
                close(other, pos, "defensive_rebound")
            begin(team, pos, period)
        else:
            begin(team, pos, period)
            open_[team]["points"] += FIELD_GOALS.get(play, 0)
            if play in FIELD_GOALS:
                close(team, pos, "made_shot")
            elif play == "TO":
                close(team, pos, "turnover")
        after_out = False
    for t in list(open_):
        close(t, last[1], "end_of_period")
    return closed, off


def test_against_the_sequential_rules(spark):
    rows = random_games(5, 60)
    shape = "game int, pos int, playtype string, team string, player string, period int, home string, away string"
    df = spark.createDataFrame(rows, shape)
    trips = {(r["game"], r["pos"]): r for r in episodes.trips(df, PLAYS).where("trip IS NOT NULL").collect()}
    made = sorted(
        (r["game"], r["team"], r["period"], r["start"], r["end"], r["end_reason"], r["points"])
        for r in episodes.possessions(df, PLAYS).collect()
    )
    off = {(r["game"], r["team"]): r["points"] for r in episodes.off_possession_points(df, PLAYS).collect()}
    expected, expected_off = [], {}
    for game in range(60):
        own = [r for r in rows if r[0] == game]
        for pos, t in sequential_trips(own).items():
            r = trips[game, pos]
            assert (r["trip_position"], r["trip_size"], r["and_one"], r["excluded"]) == t[1:]
        closed, o = sequential_possessions(own)
        expected += [(game, p["team"], p["period"], p["start"], p["end"], p["reason"], p["points"]) for p in closed]
        expected_off |= {(game, t): n for t, n in o.items()}
    assert made == sorted(expected)
    assert off == expected_off
    assert len(made) > 500


def test_vocabulary(spark):
    df = spark.createDataFrame([(1, 0, "2FGM"), (1, 1, "XX"), (1, 2, None)], "game int, pos int, playtype string")
    assert {r["pos"] for r in episodes.unknown_plays(df, PLAYS).collect()} == {1, 2}


def test_gate_and_attachment(spark):
    rows = [(1, i, "TO", "H", "x", 1, "H", "A") for i in range(4)] + [(1, 4, "TO", "A", "x", 1, "H", "A")]
    shape = "game int, pos int, playtype string, team string, player string, period int, home string, away string"
    df = spark.createDataFrame(rows, shape)
    found = episodes.possessions(df, PLAYS)
    sides = spark.createDataFrame([(1, "H", "A")], "game int, home string, away string")
    assert [(r["n_home"], r["n_away"]) for r in episodes.possession_gate(found, PLAYS, sides).collect()] == [(4, 1)]
    attached = episodes.attach(df, found, ("game",), "pos")
    assert {r["pos"]: r["possession_index"] for r in attached.collect()} == {i: i for i in range(5)}
