"""The query views: functions from a season's tables to DataFrames with one documented grain each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyline.functions.scalars import real_coordinate, shot_made, shot_type, winner
from rallyline.operators.rosters import KEYS
from rallyline.plans.season import Derived, Season


def v_game(d: Derived) -> DataFrame:
    """One row per game: sides, score, winner (null in a tie), quarantine verdict."""
    verdict = d.verdicts.select(*KEYS, "excluded", "reasons")
    rows = d.games.join(verdict, list(KEYS), "left")
    return rows.select(
        *KEYS, "round", "phase", "utc_date", "home", "away", "home_name", "away_name", "home_score", "away_score",
        winner(F.col("home"), F.col("away"), F.col("home_score"), F.col("away_score")).alias("winner"),
        F.coalesce("excluded", F.lit(False)).alias("excluded"), F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"),
    )


def v_team_game(s: Season, d: Derived) -> DataFrame:
    """One row per team and game: official totals, the opponent's, and both sides' possessions."""
    total = s.team_rows.where("row_kind = 'total'").drop("row_kind", "coach")
    other = total.select(*KEYS, F.col("team").alias("opponent"), *[F.col(c).alias(f"opp_{c}") for c in total.columns if c not in (*KEYS, "team")])
    rows = total.join(other, list(KEYS)).where("team <> opponent")
    counts = d.possessions.groupBy(*KEYS, "team").agg(F.count("*").alias("possessions"))
    rows = rows.join(counts, [*KEYS, "team"], "left")
    rows = rows.join(counts.select(*KEYS, F.col("team").alias("opponent"), F.col("possessions").alias("opp_possessions")), [*KEYS, "opponent"], "left")
    return rows.join(v_game(d).select(*KEYS, "home", "away", "utc_date", "phase", "round", "excluded", "reasons"), list(KEYS))


def v_player_game(s: Season, d: Derived) -> DataFrame:
    """One row per listed player and game: official statistics, seconds by basis, and the team's possessions."""
    seconds = d.minutes.select(*KEYS, "team", "player_id", "seconds_raw", "seconds_corrected", "seconds_official")
    rows = s.players.drop("name").join(seconds, [*KEYS, "team", "player_id"]).join(d.dimension_players, "player_id", "left")
    counts = d.possessions.groupBy(*KEYS, "team").agg(F.count("*").alias("team_possessions"))
    return rows.join(counts, [*KEYS, "team"], "left").join(v_game(d).select(*KEYS, "excluded"), list(KEYS))


def v_lineup_player(d: Derived) -> DataFrame:
    """One row per unit and player."""
    return d.lineup_players.join(d.dimension_players.drop("name_season"), "player_id", "left")


def v_possession(d: Derived) -> DataFrame:
    return d.possessions.join(v_game(d).select(*KEYS, "phase", "utc_date", "excluded"), list(KEYS))


def v_play_by_play(d: Derived) -> DataFrame:
    """One row per event in its order, with the units on the floor and the marks that say how far to trust it."""
    rows = d.events.join(d.dimension_players, "player_id", "left")
    return rows.join(v_game(d).select(*KEYS, "excluded"), list(KEYS))


def v_shot_data(s: Season, d: Derived) -> DataFrame:
    """Shot events of the stream with coordinates where the shot feed has the same number; the sentinel is null."""
    kind = shot_type(F.col("playtype"))
    rows = d.events.where(kind.isNotNull()).withColumn("shot_type", kind).withColumn("made", shot_made(F.col("playtype")))
    feed = s.shots.select(*KEYS, "number", F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("zone").alias("_zone"), "fastbreak", "second_chance", "off_turnover")
    rows = rows.join(feed, [*KEYS, "number"], "left")
    x, y = F.col("_x"), F.col("_y")
    for name in ("x", "y", "zone"):
        rows = rows.withColumn(name, real_coordinate(x, y, F.col(f"_{name}")))
    rows = rows.withColumn("has_real_coordinate", F.col("x").isNotNull())
    rows = rows.join(d.dimension_players, "player_id", "left").join(v_game(d).select(*KEYS, "excluded", "reasons"), list(KEYS))
    return rows.select(
        *KEYS, "pos", "number", "period", "clock", "team", "player_id", "name", "playtype", "shot_type", "made", "x", "y", "zone",
        "has_real_coordinate", "fastbreak", "second_chance", "off_turnover", "excluded", "reasons",
    )
