"""The ten tools, the resolver, the envelope and the JSON-RPC lines over the synthetic season."""

import json

import pytest
from test_season import league  # noqa: F401

from rallyline.plans import protocol
from rallyline.plans.envelope import Answer, BadRequest, clamp
from rallyline.plans.tools import Ambiguous, League, Unknown


@pytest.fixture(scope="module")
def served(league):  # noqa: F811
    return League(league[2], league[3]), league[1]


def test_limits_and_basis():
    assert clamp(None) == 50 and clamp(1000) == 200
    with pytest.raises(BadRequest):
        clamp(0)
    with pytest.raises(BadRequest):
        Answer([{"seconds": 1}], [], {}).as_dict()
    made = Answer([{"a": 1}], [], {}, offset=2, total_available=9).as_dict()
    assert made["truncated"] and made["next_offset"] == 3


def test_resolver(served):
    lg, _ = served
    assert lg.resolve_team("S1", "aaa") == "AAA" and lg.resolve_team("S1", "beta") == "BBB"
    with pytest.raises(Ambiguous):
        lg.resolve_team("S1", "club")
    with pytest.raises(Unknown):
        lg.resolve_team("S1", "zzz")
    with pytest.raises(Unknown):
        lg.resolve_season("S9")


def test_games(served):
    lg, facts = served
    made = lg.find_games("S1")
    assert [r["game"] for r in made["rows"]] == [1, 3] and made["excluded"]["games"] == 2
    assert made["excluded"]["reasons"] == {"minutes_mismatch": 1, "off_court_attribution": 1}
    assert len(lg.find_games("S1", include_quarantined=True)["rows"]) == 4
    assert [r["game"] for r in lg.find_games("S1", team="AAA", opponent="CCC", from_date="2024-10-03", to_date="2024-10-03")["rows"]] == [3]
    one = lg.game("S1", 1)["rows"]
    assert [r["side"] for r in one] == ["home", "away"] and [r["points"] for r in one] == list(facts[1]["score"].values())
    with pytest.raises(BadRequest):
        lg.game("S1", 2)
    with pytest.raises(Unknown):
        lg.game("S1", 77)


def test_team_and_player_stats(served):
    lg, facts = served
    rows = lg.team_stats("S1")["rows"]
    ratings = [r["offensive_rating"] for r in rows]
    assert len(rows) == 3 and ratings == sorted(ratings, reverse=True)
    with pytest.raises(BadRequest):
        lg.team_stats("S1", clutch_max_margin=5)
    assert lg.team_stats("S1", clutch_max_seconds_remaining=300, clutch_max_margin=99)["caveats"]
    made = lg.player_stats("S1", limit=5)
    assert made["truncated"] and made["minutes_basis"] == "corrected" and len(made["rows"]) == 5
    total = lg.player_stats("S1", player="PAAA1", minutes_basis="raw")["rows"][0]
    assert total["seconds"] == sum(facts[g]["seconds"].get("PAAA1", 0) for g in (1, 3))
    with pytest.raises(BadRequest):
        lg.player_stats("S1", minutes_basis="x")


def test_lineups_and_on_off(served):
    lg, _ = served
    rows = lg.lineup_stats("S1", min_possessions=1)["rows"]
    nets = [r["net_rating"] for r in rows if r["net_rating"] is not None]
    assert nets == sorted(nets, reverse=True) and all(r["players"].count(" | ") == 4 for r in rows)
    on_off = lg.player_on_off("S1", "PAAA0")
    assert [r["split"] for r in on_off["rows"]] == ["on", "off"][: len(on_off["rows"])]
    every = lg.possessions("S1", team="AAA", aggregate=True)["rows"][0]["possessions"]
    assert sum(r["possessions"] for r in on_off["rows"]) == every


def test_rows(served):
    lg, _ = served
    shots = lg.shot_data("S1", shot_type="3P", made=True, only_with_real_coordinates=True)
    assert shots["rows"] and all(r["made"] and r["x"] == 10 for r in shots["rows"])
    assert lg.shot_data("S1", offset=100_000)["empty_result"] == "page_out_of_range"
    assert lg.shot_data("S1", period=9)["empty_result"] == "no_matching_shots"
    made = lg.possessions("S1", game=1, limit=3)
    assert [r["possession_index"] for r in made["rows"]] == [0, 1, 2] and made["minutes_basis"] == "raw" and len(made["caveats"]) == 2
    plays = lg.play_by_play("S1", 1, from_index=5, limit=2)
    assert [r["pos"] for r in plays["rows"]] == [5, 6]
    with pytest.raises(Unknown):
        lg.play_by_play("S1", 1, playtype="nothing")
    about = lg.describe_warehouse()["rows"][0]
    assert about["teams"] == 3 and [t["team"] for t in about["team_list"]] == ["AAA", "BBB", "CCC"]
    assert {"trip", "is_team_event", "attribution_suspect", "clock_moved_backwards", "lineup_home", "lineup_away", "elapsed_corrected"} <= plays["rows"][0].keys()
    suspect = [r for r in lg.play_by_play("S1", 4, limit=200, from_index=0, include_quarantined=True, playtype="AS")["rows"]]
    assert [r["attribution_suspect"] for r in suspect] == [True]


def test_numbers_come_from_sums(served):
    """Ratings are rounded once, from sums; totals and averages of players and possessions agree with the facts."""
    from decimal import ROUND_HALF_UP, Decimal

    lg, facts = served
    half_up = lambda x, n: Decimal(x).quantize(Decimal(1).scaleb(-n), ROUND_HALF_UP)
    exact = lambda a, b: Decimal(100) * a / b
    for r in [*lg.lineup_stats("S1", min_possessions=1)["rows"], *lg.player_on_off("S1", "PAAA0")["rows"]]:
        if r["possessions"] and r["opp_possessions"]:
            net = exact(r["points"], r["possessions"]) - exact(r["opp_points"], r["opp_possessions"])
            assert r["net_rating"] == half_up(net, 2)
    rows = lg.possessions("S1", aggregate=True)["rows"]
    assert [r["possessions"] for r in rows] == sorted((r["possessions"] for r in rows), reverse=True)
    every = lg.possessions("S1", team=rows[0]["team"], limit=200)
    assert every["total_available"] == rows[0]["possessions"]
    if not every["truncated"]:
        left = [r["seconds_remaining_raw"] for r in every["rows"]]
        assert rows[0]["mean_seconds_remaining_at_start"] == half_up(Decimal(sum(left)) / len(left), 1)
        assert rows[0]["straddling"] == sum(r["straddles"] for r in every["rows"])
    total, mean = (lg.player_stats("S1", player="PAAA1", per_game=p, minutes_basis="raw")["rows"][0] for p in (False, True))
    seconds = sum(facts[g]["seconds"].get("PAAA1", 0) for g in (1, 3))
    assert total["minutes"] == half_up(Decimal(seconds) / 60, 1) and mean["minutes"] == half_up(Decimal(seconds) / 60 / total["games"], 1)
    own = [facts[g]["stats"].get("PAAA1", {}) for g in (1, 3)]
    points = sum(2 * g.get("2", 0) + 3 * g.get("3", 0) + g.get("ft", 0) for g in own)
    made = sum(g.get("2", 0) + g.get("3", 0) for g in own) + Decimal("0.5") * sum(g.get("3", 0) for g in own)
    tried = sum(g.get("2a", 0) + g.get("3a", 0) for g in own)
    assert total["points"] == points and total["effective_fg"] == half_up(made / tried, 4)
    team = lg.team_stats("S1", team="AAA")["rows"][0]
    assert total["points_per_100_team_possessions"] == half_up(exact(points, team["possessions"]), 2)
    assert team["possessions_per_game"] == half_up(Decimal(team["possessions"]) / team["games"], 2)
    one = lg.game("S1", 1)["rows"]
    assert one[0]["opponent_points"] == one[1]["points"] and one[0]["opponent_possessions"] == one[1]["possessions"] and not one[0]["excluded"]


def test_json_rpc(served):
    lg, _ = served
    ask = lambda **m: json.dumps({"jsonrpc": "2.0", **m})
    call = lambda i, name, **a: ask(id=i, method="tools/call", params={"name": name, "arguments": a})
    lines = [ask(id=1, method="initialize"), ask(method="notifications/initialized"), ask(id=2, method="tools/list"), call(3, "find_games", season="S1"),
             call(4, "find_games"), call(5, "find_games", season="nope"), ask(id=6, method="x"), "not json", ask(id=7, method="ping"),
             "3", ask(id=8, method="tools/call", params=[1]), ask(id=None, method="ping"), ask(id=9, method=4),
             call(10, "shot_data", season="S1", game="x"), ask(id=11, method="initialize", params={"protocolVersion": "2025-03-26"})]
    got = [json.loads(x) for x in protocol.serve(lg, lines)]
    assert [x["id"] for x in got] == [1, 2, 3, 4, 5, 6, None, 7, None, 8, 9, 10, 11]
    assert [x["error"]["code"] for x in got if "error" in x] == [-32602, -32601, -32700, -32600, -32602, -32600]
    assert got[11]["result"]["isError"] and got[12]["result"]["protocolVersion"] == "2025-03-26"
    assert got[0]["result"]["protocolVersion"] == protocol.VERSIONS[0] and got[1]["result"]["tools"][0]["description"]
    assert len(got[1]["result"]["tools"]) == 10
    for wrong, what in ((call(1, "nope"), "known: describe_warehouse, shot_data"), (call(1, "game", season="S1", x=1), "game: "), (ask(id=1, method="initialize", params={"league": 1}), "TypeError")):
        (reply,) = (json.loads(x) for x in protocol.serve(lg, [wrong]))
        assert what in reply["error"]["message"] and reply["error"]["code"] == (-32603 if what == "TypeError" else -32602)
    assert json.loads(got[2]["result"]["content"][0]["text"])["row_count"] == 2
    assert got[3]["error"]["code"] == -32602 and got[4]["result"]["isError"] and got[5]["error"]["code"] == -32601
