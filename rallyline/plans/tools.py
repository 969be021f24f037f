"""The query surface: ten read-only, parameterised questions over a season's views.

Arguments become Column predicates, so Catalyst pushes them down; at most 200 rows come to the driver.  Quarantined
games are left out unless asked for, and every answer says how many.  Every order is total.
"""

from __future__ import annotations

from datetime import date
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyline.functions.scalars import effective_field_goals, name_like, net_rate, rate
from rallyline.operators.rosters import KEYS
from rallyline.plans import views
from rallyline.plans.envelope import Answer, BadRequest, clamp
from rallyline.plans.season import Derived, Season

BASES = {"corrected": "seconds_corrected", "raw": "seconds_raw", "official": "seconds_official"}


class Unknown(BadRequest):
    """No such season, team, player or game."""


class Ambiguous(BadRequest):
    """More than one name fits."""


class League:
    """Answers over one set of season tables."""

    def __init__(self, season: Season, derived: Derived) -> None:
        self.season, self.derived = season, derived
        # one row for each game, which every answer asks for its coverage and exclusions
        self.games = views.v_game(derived).cache()

    def close(self) -> None:
        """Let go of what the answers share."""
        self.games.unpersist()

    # -- helpers ---------------------------------------------------------------------------------------------------

    def resolve_season(self, season: str) -> str:
        known = [r[0] for r in self.games.select("season").distinct().orderBy("season").collect()]
        if season not in known:
            raise Unknown(f"unknown season {season!r}; known: {', '.join(known)}")
        return season

    def _resolve(self, rows: DataFrame, key: str, wanted: str, what: str) -> str:
        exact = rows.where(F.upper(F.col(key)) == wanted.upper()).limit(1).collect()
        if exact:
            return exact[0][key]
        found = rows.where(name_like(F.col("name"), wanted)).select(key, "name").distinct().orderBy(key).limit(11).collect()
        if not found:
            raise Unknown(f"unknown {what} {wanted!r}")
        if len(found) > 1:
            raise Ambiguous(f"{what} {wanted!r} could be: {', '.join(f'{r[key]} ({r["name"]})' for r in found[:10])}")
        return found[0][key]

    def resolve_team(self, season: str, team: str) -> str:
        return self._resolve(self.derived.dimension_teams.where(F.col("season") == season), "team", team, "team")

    def resolve_player(self, player: str) -> str:
        return self._resolve(self.derived.dimension_players, "player_id", player, "player")

    def coverage(self, season: str | None = None) -> list[dict[str, Any]]:
        return self._notes(season)[0]

    def exclusions(self, season: str | None, included: bool) -> dict[str, Any]:
        return {"included": included} | self._notes(season)[1]

    def _notes(self, season: str | None) -> tuple[list[dict[str, Any]], dict[str, Any]]:
        """Coverage by season, and the excluded games by reason, from one aggregate by verdict: a few rows a season."""
        rows = self.games if season is None else self.games.where(F.col("season") == season)
        day = F.col("utc_date").cast("date")
        got = rows.groupBy("season", "excluded", "reasons").agg(F.count("*").alias("n"), F.min(day).alias("first"), F.max(day).alias("last")).collect()
        coverage: dict[str, dict[str, Any]] = {}
        reasons: dict[str, int] = {}
        for r in sorted(got, key=lambda r: r["season"]):
            c = coverage.setdefault(r["season"], {"season": r["season"], "games": 0, "excluded_games": 0, "first_date": r["first"], "last_date": r["last"]})
            c["games"] += r["n"]
            c["first_date"], c["last_date"] = min(c["first_date"], r["first"]), max(c["last_date"], r["last"])
            if r["excluded"]:
                c["excluded_games"] += r["n"]
                for reason in r["reasons"]:
                    reasons[reason] = reasons.get(reason, 0) + r["n"]
        out = sum(c["excluded_games"] for c in coverage.values())
        return list(coverage.values()), {"games": out, "reasons": dict(sorted(reasons.items()))}

    def _visible(self, rows: DataFrame, season: str, include_quarantined: bool) -> DataFrame:
        rows = rows.where(F.col("season") == season)
        return rows if include_quarantined else rows.where("NOT excluded")

    def _answer(self, season: str, rows: DataFrame, order: list[Column | str], include: bool, limit: int | None = None, offset: int = 0, estimate: bool = False, **more: Any) -> dict[str, Any]:
        n = clamp(limit)
        if offset < 0:
            raise BadRequest("offset must not be negative")
        got = [r.asDict() for r in rows.orderBy(*order).offset(offset).limit(n).collect()]
        total = offset + len(got) + (len(got) == n) if estimate else rows.count()
        reason = more.pop("empty_reason", None)
        if not got and offset and total:
            reason = "page_out_of_range"
        coverage, out = self._notes(season)
        return Answer(got, coverage, {"included": include} | out, offset, total, empty_reason=reason, **more).as_dict()

    # -- the ten tools ---------------------------------------------------------------------------------------------

    def describe_warehouse(self, include_quarantined: bool = False) -> dict[str, Any]:
        """Seasons, teams, coordinate coverage and excluded games: what to read first."""
        teams: dict[str, list[dict[str, str]]] = {}
        for r in self.derived.dimension_teams.orderBy("season", "team").collect():  # a few dozen a season
            teams.setdefault(r["season"], []).append({"team": r["team"], "name": r["name"]})
        shots = views.v_shot_data(self.season, self.derived).where("shot_type <> 'FT'").groupBy("season")
        found = {r["season"]: r for r in shots.agg(F.count("*").alias("n"), F.count_if("has_real_coordinate").alias("real")).collect()}
        rows = self.coverage()
        for r in rows:
            s = found.get(r["season"])
            r |= {"teams": len(teams.get(r["season"], [])), "team_list": teams.get(r["season"], []), "field_goals": s["n"] if s else 0, "with_real_coordinates": s["real"] if s else 0}
        return Answer(rows, self.coverage(), self.exclusions(None, include_quarantined), total_available=len(rows)).as_dict()

    def shot_data(self, season: str, game: int | None = None, team: str | None = None, player: str | None = None, period: int | None = None, made: bool | None = None,
                  shot_type: str | None = None, only_with_real_coordinates: bool = False, limit: int | None = None, offset: int = 0, include_quarantined: bool = False) -> dict[str, Any]:
        """Shot events with their coordinates where the feed has real ones."""
        season = self.resolve_season(season)
        if shot_type not in (None, "2P", "3P", "FT"):
            raise BadRequest("shot_type must be 2P, 3P or FT")
        if made is not None and not isinstance(made, bool):
            raise BadRequest("made must be true or false")
        rows = self._visible(views.v_shot_data(self.season, self.derived), season, include_quarantined)
        wanted = {"game": game, "period": period, "made": made, "shot_type": shot_type}
        wanted |= {"team": self.resolve_team(season, team) if team else None, "player_id": self.resolve_player(player) if player else None}
        for c, v in wanted.items():
            rows = rows if v is None else rows.where(F.col(c) == v)
        loaded = self.season.shots.where(F.col("season") == season).limit(1).count() > 0
        reason = "no_matching_shots" if loaded or not only_with_real_coordinates else "shot_coordinates_not_loaded"
        rows = rows.where("has_real_coordinate") if only_with_real_coordinates else rows
        return self._answer(season, rows, ["game", "pos"], include_quarantined, limit, offset, empty_reason=reason)

    def find_games(self, season: str, team: str | None = None, opponent: str | None = None, from_date: str | None = None, to_date: str | None = None, phase: str | None = None,
                   round_number: int | None = None, limit: int | None = None, offset: int = 0, include_quarantined: bool = False) -> dict[str, Any]:
        """Games of a season by team, opponent, dates, phase or round."""
        season = self.resolve_season(season)
        rows = self._visible(self.games, season, include_quarantined)
        for t in filter(None, (team, opponent)):
            code = self.resolve_team(season, t)
            rows = rows.where((F.col("home") == code) | (F.col("away") == code))
        day = F.col("utc_date").cast("date")
        if from_date:
            rows = rows.where(day >= F.lit(date.fromisoformat(from_date)))
        if to_date:
            rows = rows.where(day <= F.lit(date.fromisoformat(to_date)))
        rows = rows if phase is None else rows.where(F.upper("phase") == phase.upper())
        rows = rows if round_number is None else rows.where(F.col("round") == round_number)
        return self._answer(season, rows, ["utc_date", "game"], include_quarantined, limit, offset)

    def _factors(self, rows: DataFrame) -> DataFrame:
        """Four factors and ratings from summed columns; rounding is decimal."""
        made = F.col("field_goals_made2") + F.col("field_goals_made3")
        tried = F.col("field_goals_attempted2") + F.col("field_goals_attempted3")
        return rows.withColumns({
            "effective_fg": effective_field_goals(made, F.col("field_goals_made3"), tried),
            "turnover_rate": rate(F.col("turnovers"), F.col("possessions"), 4),
            "offensive_rebound_rate": rate(F.col("offensive_rebounds"), F.col("offensive_rebounds") + F.col("opp_defensive_rebounds"), 4),
            "free_throw_rate": rate(F.col("free_throws_attempted"), tried, 4),
            "offensive_rating": rate(F.col("points"), F.col("possessions"), 2, 100),
            "defensive_rating": rate(F.col("opp_points"), F.col("opp_possessions"), 2, 100),
        })

    FACTORS = ("effective_fg", "turnover_rate", "offensive_rebound_rate", "free_throw_rate", "offensive_rating", "defensive_rating")

    def game(self, season: str, gamecode: int, include_quarantined: bool = False) -> dict[str, Any]:
        """One game: both sides' box score, possessions and four factors."""
        season = self.resolve_season(season)
        one = self.games.where((F.col("season") == season) & (F.col("game") == gamecode)).collect()
        if not one:
            raise Unknown(f"unknown game {gamecode} in {season}")
        if one[0]["excluded"] and not include_quarantined:
            raise BadRequest(f"game {gamecode} is quarantined ({', '.join(one[0]['reasons'])}); ask with include_quarantined")
        rows = views.v_team_game(self.season, self.derived).where((F.col("season") == season) & (F.col("game") == gamecode))
        rows = self._factors(rows).withColumn("side", F.when(F.col("team") == F.col("home"), "home").otherwise("away"))
        rows = rows.withColumns({
            "field_goals_made": F.col("field_goals_made2") + F.col("field_goals_made3"),
            "field_goals_attempted": F.col("field_goals_attempted2") + F.col("field_goals_attempted3"),
        })
        rows = rows.select(
            "game", "side", "team", "opponent", "points", F.col("opp_points").alias("opponent_points"), "field_goals_made", "field_goals_attempted",
            F.col("field_goals_made3").alias("three_pointers_made"), F.col("field_goals_attempted3").alias("three_pointers_attempted"),
            "free_throws_made", "free_throws_attempted", "offensive_rebounds", "defensive_rebounds", F.col("assistances").alias("assists"), "steals",
            "turnovers", "fouls_commited", "possessions", F.col("opp_possessions").alias("opponent_possessions"), *self.FACTORS, "excluded", "reasons",
        )
        return self._answer(season, rows, [F.desc("side")], include_quarantined)

    def team_stats(self, season: str, team: str | None = None, clutch_max_seconds_remaining: int | None = None, clutch_max_margin: int | None = None,
                   include_quarantined: bool = False) -> dict[str, Any]:
        """Season totals, four factors and ratings by team; optionally of late and close possessions."""
        season = self.resolve_season(season)
        if (clutch_max_seconds_remaining is None) != (clutch_max_margin is None):
            raise BadRequest("both clutch arguments or neither")
        rows = self._visible(views.v_team_game(self.season, self.derived), season, include_quarantined)
        caveats = []
        if clutch_max_margin is not None:
            # team-games without such a possession drop out of all sums
            late = self.derived.possessions.where((F.col("seconds_remaining_raw") <= clutch_max_seconds_remaining) & (F.abs("margin_at_start") <= clutch_max_margin))
            late = late.groupBy(*KEYS, "team").agg(F.count("*").alias("clutch_possessions"), F.sum("points").alias("clutch_points"))
            rows = rows.join(late, [*KEYS, "team"])
            caveats.append("Only games in which the team had such a possession count, in every column.")
        else:
            rows = rows.withColumns({"clutch_possessions": F.lit(None).cast("long"), "clutch_points": F.lit(None).cast("long")})
        if team:
            rows = rows.where(F.col("team") == self.resolve_team(season, team))
        summed = ["points", "opp_points", "possessions", "opp_possessions", "field_goals_made2", "field_goals_made3", "field_goals_attempted2", "field_goals_attempted3",
                  "turnovers", "offensive_rebounds", "opp_defensive_rebounds", "free_throws_attempted", "clutch_possessions", "clutch_points"]
        rows = rows.groupBy("team").agg(F.count("*").alias("games"), *[F.sum(c).alias(c) for c in summed])
        rows = self._factors(rows).withColumn("clutch_rating", rate(F.col("clutch_points"), F.col("clutch_possessions"), 2, 100))
        rows = rows.withColumn("possessions_per_game", rate(F.col("possessions"), F.col("games"), 2))
        rows = rows.select("team", "games", "points", "possessions", "possessions_per_game", *self.FACTORS, "clutch_possessions", "clutch_rating")
        return self._answer(season, rows, [F.desc_nulls_last("offensive_rating"), "team"], include_quarantined, 200, caveats=caveats)

    def player_stats(self, season: str, player: str | None = None, team: str | None = None, per_game: bool = False, minutes_basis: str = "corrected", min_seconds: int = 0,
                     limit: int | None = None, offset: int = 0, include_quarantined: bool = False) -> dict[str, Any]:
        """Season totals or averages by player, with minutes on a stated basis."""
        season = self.resolve_season(season)
        if minutes_basis not in BASES:
            raise BadRequest(f"minutes_basis must be one of {', '.join(BASES)}")
        rows = self._visible(views.v_player_game(self.season, self.derived), season, include_quarantined).where("seconds_official > 0")
        if player:
            rows = rows.where(F.col("player_id") == self.resolve_player(player))
        if team:
            rows = rows.where(F.col("team") == self.resolve_team(season, team))
        rows = rows.withColumn("seconds", F.col(BASES[minutes_basis]))
        counted = {"points": "points", "rebounds": "total_rebounds", "assists": "assistances", "steals": "steals", "turnovers": "turnovers", "valuation": "valuation"}
        hidden = ["seconds", "team_possessions", "field_goals_made2", "field_goals_made3", "field_goals_attempted2", "field_goals_attempted3"]
        made = rows.groupBy("player_id").agg(
            F.max("name").alias("name"), F.max("team").alias("team"), F.count("*").alias("games"),
            *[F.sum(c).alias(name) for name, c in counted.items()], *[F.sum(c).alias(f"_{c}") for c in hidden],
        )
        made = made.where(F.col("_seconds") >= min_seconds)
        # one rounding, of sums: rates and averages of rounded parts would drift
        by = F.col("games") if per_game else F.lit(1)
        goals = F.col("_field_goals_made2") + F.col("_field_goals_made3")
        tried = F.col("_field_goals_attempted2") + F.col("_field_goals_attempted3")
        made = made.select(
            "player_id", "name", "team", "games", rate(F.col("_seconds"), by * 60, 1).alias("minutes"),
            *[rate(F.col(c), by, 2).alias(c) for c in counted], effective_field_goals(goals, F.col("_field_goals_made3"), tried).alias("effective_fg"),
            rate(F.col("points"), F.col("_team_possessions"), 2, 100).alias("points_per_100_team_possessions"), F.col("_seconds").alias("seconds"),
        )
        return self._answer(season, made, [F.desc_nulls_last("points"), "player_id"], include_quarantined, limit, offset, estimate=True, basis=minutes_basis)

    def lineup_stats(self, season: str, team: str | None = None, contains_player: str | None = None, min_possessions: int = 25, limit: int | None = None, offset: int = 0,
                     include_quarantined: bool = False) -> dict[str, Any]:
        """Five-player units with both ratings, by net rating."""
        season = self.resolve_season(season)
        rows = self._visible(views.v_possession(self.derived), season, include_quarantined)
        own = rows.groupBy(F.col("offense_lineup").alias("lineup_id")).agg(F.count("*").alias("possessions"), F.sum("points").alias("points"))
        against = rows.groupBy(F.col("defense_lineup").alias("lineup_id")).agg(F.count("*").alias("opp_possessions"), F.sum("points").alias("opp_points"))
        people = views.v_lineup_player(self.derived)
        names = people.groupBy("lineup_id", "team").agg(F.expr("listagg(name, ' | ') WITHIN GROUP (ORDER BY name)").alias("players"))
        made = names.join(own, "lineup_id", "left").join(against, "lineup_id", "left").fillna(0, ["possessions", "points", "opp_possessions", "opp_points"])
        if contains_player:
            made = made.join(people.where(F.col("player_id") == self.resolve_player(contains_player)).select("lineup_id"), "lineup_id", "left_semi")
        if team:
            made = made.where(F.col("team") == self.resolve_team(season, team))
        made = made.where(F.col("possessions") >= min_possessions)
        made = made.withColumns({"offensive_rating": rate(F.col("points"), F.col("possessions"), 2, 100), "defensive_rating": rate(F.col("opp_points"), F.col("opp_possessions"), 2, 100)})
        made = made.withColumn("net_rating", net_rate(F.col("points"), F.col("possessions"), F.col("opp_points"), F.col("opp_possessions")))
        return self._answer(season, made, [F.desc_nulls_last("net_rating"), "lineup_id"], include_quarantined, limit, offset, estimate=True,
                            caveats=["The floor counts possessions on offence alone."])

    def player_on_off(self, season: str, player: str, team: str | None = None, include_quarantined: bool = False) -> dict[str, Any]:
        """Ratings of a player's team with the player on the floor and off it."""
        season = self.resolve_season(season)
        who = self.resolve_player(player)
        units = views.v_lineup_player(self.derived).where(F.col("player_id") == who).select("lineup_id", "team").distinct()
        teams = units.select("team").distinct()
        if team:
            teams = teams.where(F.col("team") == self.resolve_team(season, team))
        rows = self._visible(views.v_possession(self.derived), season, include_quarantined)
        flags = units.select("lineup_id", F.lit(True).alias("has"))

        def side(of: str, lineup: str, prefix: str) -> DataFrame:
            own = rows.join(teams, rows[of] == teams["team"]).drop(teams["team"]).withColumn("side_team", F.col(of))
            own = own.join(flags, own[lineup] == flags["lineup_id"], "left").withColumn("split", F.when(F.col("has"), "on").otherwise("off"))
            return own.groupBy("side_team", "split").agg(F.count("*").alias(f"{prefix}possessions"), F.sum("points").alias(f"{prefix}points"))

        made = side("team", "offense_lineup", "").join(side("opponent", "defense_lineup", "opp_"), ["side_team", "split"])
        made = made.withColumns({"offensive_rating": rate(F.col("points"), F.col("possessions"), 2, 100), "defensive_rating": rate(F.col("opp_points"), F.col("opp_possessions"), 2, 100)})
        made = made.withColumn("net_rating", net_rate(F.col("points"), F.col("possessions"), F.col("opp_points"), F.col("opp_possessions")))
        made = made.withColumnRenamed("side_team", "team")
        return self._answer(season, made, ["team", F.desc("split")], include_quarantined, 200, caveats=["'off' includes games that the player missed."])

    def possessions(self, season: str, game: int | None = None, team: str | None = None, lineup_id: str | None = None, max_seconds_remaining: int | None = None,
                    max_margin: int | None = None, end_reason: str | None = None, aggregate: bool = False, limit: int | None = None, offset: int = 0,
                    include_quarantined: bool = False) -> dict[str, Any]:
        """Possessions one by one, or summed by team."""
        season = self.resolve_season(season)
        rows = self._visible(views.v_possession(self.derived), season, include_quarantined)
        for c, v in {"game": game, "offense_lineup": lineup_id, "end_reason": end_reason, "team": self.resolve_team(season, team) if team else None}.items():
            rows = rows if v is None else rows.where(F.col(c) == v)
        rows = rows if max_seconds_remaining is None else rows.where(F.col("seconds_remaining_raw") <= max_seconds_remaining)
        rows = rows if max_margin is None else rows.where(F.abs("margin_at_start") <= max_margin)
        if aggregate:
            left = F.sum("seconds_remaining_raw").alias("_left")
            made = rows.groupBy("team").agg(
                F.count("*").alias("possessions"), F.sum("points").alias("points"), F.count_if("straddles").alias("straddling"), left,
                F.count("seconds_remaining_raw").alias("_known"),
            )
            made = made.select(
                "team", "possessions", "points", rate(F.col("points"), F.col("possessions"), 2, 100).alias("points_per_100"), "straddling",
                rate(F.col("_left"), F.col("_known"), 1).alias("mean_seconds_remaining_at_start"),
            )
            return self._answer(season, made, [F.desc("possessions"), "team"], include_quarantined, 200, basis="raw")
        return self._answer(season, rows.drop("excluded", "phase", "utc_date"), ["game", "possession_index"], include_quarantined, limit, offset, basis="raw",
                            caveats=["Time left and margin are those at the possession's first event, its own basket included."])

    def play_by_play(self, season: str, gamecode: int, period: int | None = None, playtype: str | None = None, from_index: int | None = None, limit: int | None = None,
                     offset: int = 0, include_quarantined: bool = False) -> dict[str, Any]:
        """One game's events in their only valid order, with units, possession and trip."""
        season = self.resolve_season(season)
        rows = self._visible(views.v_play_by_play(self.derived), season, include_quarantined).where(F.col("game") == gamecode)
        rows = rows if period is None else rows.where(F.col("period") == period)
        rows = rows if playtype is None else rows.where(F.col("playtype") == playtype.upper())
        rows = rows if from_index is None else rows.where(F.col("pos") >= from_index)
        rows = rows.select(
            "game", "pos", "period", "clock", "playtype", "team", "player_id", "name", "score_a", "score_b", "lineup_home", "lineup_away", "stint",
            "possession_index", "trip", "is_team_event", F.col("clock_backwards").alias("clock_moved_backwards"), "attribution_suspect", "elapsed_corrected",
        )
        made = self._answer(season, rows, ["pos"], include_quarantined, limit, offset, basis="corrected")
        if not made["rows"] and not offset:
            raise Unknown(f"no such plays in game {gamecode} of {season}")
        return made
