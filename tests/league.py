"""A small synthetic season as payload files, with known defects by game."""

import json
import random

TEAMS = {"AAA": "Alpha Club", "BBB": "Beta Club", "CCC": "Gamma Club"}
SQUAD = 8
GAMES = {1: ("AAA", "BBB"), 2: ("BBB", "CCC"), 3: ("CCC", "AAA"), 4: ("AAA", "CCC")}


def pid(team, i):
    return f"P{team}{i}"


def clock(seconds):
    return f"{seconds // 60:02d}:{seconds % 60:02d}"


def game_events(game, home, away, rng, overtime=False, defect=None):
    """Periods of raw events, official box numbers and the facts to hold results against."""
    court = {t: [pid(t, i) for i in range(5)] for t in (home, away)}
    bench = {t: [pid(t, i) for i in range(5, SQUAD)] for t in (home, away)}
    entered = {p: 0 for t in court for p in court[t]}
    seconds, stats = {}, {}
    score = {home: 0, away: 0}
    number = 0
    lists = []

    def row(play, team="", player="", at=None, points=False):
        nonlocal number
        number += 1
        return {
            "NUMBEROFPLAY": number, "PLAYTYPE": play.ljust(6), "PLAYER_ID": player.ljust(10), "CODETEAM": team.ljust(10),
            "MARKERTIME": clock(at) if at is not None else "", "MINUTE": 1,
            "POINTS_A": score[home] if points else None, "POINTS_B": score[away] if points else None,
        }

    def bump(player, key, n=1):
        stats.setdefault(player, {})[key] = stats.get(player, {}).get(key, 0) + n

    attack = home
    for period in range(1, 6 if overtime else 5):
        length, start = (600, 600 * (period - 1)) if period < 5 else (300, 2400)
        out = [row("BP")]
        left = length
        while left > 25:
            left -= rng.randint(8, 22)
            shooter = rng.choice(court[attack])
            other = away if attack == home else home
            kind = rng.random()
            if kind < 0.4:
                three = rng.random() < 0.35
                score[attack] += 3 if three else 2
                bump(shooter, "3" if three else "2")
                bump(shooter, "3a" if three else "2a")
                out.append(row("3FGM" if three else "2FGM", attack, shooter, left, True))
            elif kind < 0.55:
                out.append(row("TO", attack, shooter, left))
                bump(shooter, "to")
            elif kind < 0.7:
                out.append(row("CM", other, rng.choice(court[other]), left))
                for shot in range(2):
                    if rng.random() < 0.7 or shot == 1:
                        score[attack] += 1
                        bump(shooter, "ft")
                        out.append(row("FTM", attack, shooter, left, True))
                    else:
                        out.append(row("FTA", attack, shooter, left))
                    bump(shooter, "fta")
            else:
                out.append(row("2FGA", attack, shooter, left))
                bump(shooter, "2a")
                rebounder = rng.choice(court[other])
                out.append(row("D", other, rebounder, left))
                bump(rebounder, "d")
            attack = other
            if rng.random() < 0.12:
                team = rng.choice((home, away))
                leaves, comes = rng.choice(court[team]), rng.choice(bench[team])
                now = start + length - left
                out += [row("OUT", team, leaves, left), row("IN", team, comes, left)]
                court[team].remove(leaves), bench[team].append(leaves)
                bench[team].remove(comes), court[team].append(comes)
                seconds[leaves] = seconds.get(leaves, 0) + now - entered.pop(leaves)
                entered[comes] = now
        out.append(row("EP"))
        lists.append(out)
    if defect == "attribution":
        idle = bench[home][0]
        lists[3].insert(-1, row("AS", home, idle, 1))
    total = 2400 + 300 * overtime
    for p, at in entered.items():
        seconds[p] = seconds.get(p, 0) + total - at
    lists[-1].append(row("EG"))
    if defect == "minutes":
        seconds[pid(home, 0)] += 30
    return lists, seconds, stats, score


def write_season(root, season="S1", seed=3):
    """Files of four games (3: overtime, 4: a play by a benched player, 2: wrong official minutes) and the facts."""
    rng, facts, data = random.Random(seed), {}, []
    base = root / season
    for e in ("PlaybyPlay", "Boxscore", "Points"):
        (base / e).mkdir(parents=True)
    for game, (home, away) in GAMES.items():
        defect = {2: "minutes", 4: "attribution"}.get(game)
        lists, seconds, stats, score = game_events(game, home, away, rng, game == 3, defect)
        facts[game] = {"home": home, "away": away, "seconds": seconds, "score": score, "lists": lists, "stats": stats}
        names = ("FirstQuarter", "SecondQuarter", "ThirdQuarter", "ForthQuarter", "ExtraTime")
        pbp = {n: (lists[i] if i < len(lists) else None) for i, n in enumerate(names)}
        (base / "PlaybyPlay" / f"{game}.json").write_text(json.dumps(pbp))
        box = {"Live": False, "Referees": "A, B, C, D", "Attendance": "10", "Stats": []}
        for team in (home, away):
            rows, sums = [], {}
            for i in range(SQUAD):
                p = pid(team, i)
                g = stats.get(p, {})
                own = {
                    "Points": 2 * g.get("2", 0) + 3 * g.get("3", 0) + g.get("ft", 0), "FieldGoalsMade2": g.get("2", 0), "FieldGoalsAttempted2": g.get("2a", 0),
                    "FieldGoalsMade3": g.get("3", 0), "FieldGoalsAttempted3": g.get("3a", 0), "FreeThrowsMade": g.get("ft", 0), "FreeThrowsAttempted": g.get("fta", 0),
                    "OffensiveRebounds": 0, "DefensiveRebounds": g.get("d", 0), "TotalRebounds": g.get("d", 0), "Assistances": 0, "Steals": 0, "Turnovers": g.get("to", 0),
                    "BlocksFavour": 0, "BlocksAgainst": 0, "FoulsCommited": 0, "FoulsReceived": 0, "Valuation": 0,
                }
                for k, v in own.items():
                    sums[k] = sums.get(k, 0) + v
                played = seconds.get(p, 0)
                rows.append({"Player_ID": p.ljust(10), "IsStarter": int(i < 5), "IsPlaying": int(played > 0), "Team": team, "Dorsal": str(i), "Player": f"PLAYER {p}",
                             "Minutes": clock(played) if played else "DNP", "Plusminus": 0, **own})
            zero = dict.fromkeys(sums, 0)
            box["Stats"].append({"Team": TEAMS[team], "Coach": "COACH", "PlayersStats": rows, "tmr": {"Team": team, "Minutes": None, **zero}, "totr": {"Team": None, "Minutes": "200:00", **sums}})
        box["Stats"].reverse()
        (base / "Boxscore" / f"{game}.json").write_text(json.dumps(box))
        shots = []
        for r in [x for part in lists for x in part if x["PLAYTYPE"].strip() in ("2FGM", "3FGM", "2FGA")]:
            real = rng.random() < 0.8
            shots.append({"NUM_ANOT": r["NUMBEROFPLAY"], "ID_PLAYER": r["PLAYER_ID"], "TEAM": r["CODETEAM"], "ID_ACTION": r["PLAYTYPE"], "COORD_X": 10 if real else -1,
                          "COORD_Y": 20 if real else -1, "ZONE": "A", "FASTBREAK": "0", "SECOND_CHANCE": "0", "POINTS_OFF_TURNOVER": "1"})
        facts[game]["shots"] = shots
        (base / "Points" / f"{game}.json").write_text(json.dumps({"Rows": shots}))
        data.append(schedule_row(game, home, away, score))
    data.append(schedule_row(9, "AAA", "BBB", None))
    (base / "schedule.json").write_text(json.dumps({"data": data}))
    return facts


def schedule_row(game, home, away, score):
    side = lambda t: {"score": score[t] if score else None, "club": {"code": t, "name": TEAMS[t]}}
    return {
        "gameCode": game, "played": score is not None, "gameStatus": "x", "round": game, "roundName": f"R{game}", "localDate": f"2024-10-{game:02d}T20:00:00",
        "utcDate": f"2024-10-{game:02d}T18:00:00Z", "isNeutralVenue": False, "phaseType": {"code": "RS", "name": "Regular"}, "season": {"competitionCode": "X"},
        "local": side(home), "road": side(away), "venue": {"code": "v", "name": "Hall", "capacity": 1}, "referee1": {"code": "1", "name": "A, B"},
    }
