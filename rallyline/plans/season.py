"""A season's derived tables from its flat ones.

Tables that several others read are written on the way (a plan that repeats them would grow with every use).  The only
global step is the season's correction switch, one row per season that is broadcast back; it is a sum of each game's own
sums, which are kept, so games can be derived at different times.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rallyline.functions.scalars import matches_official, official_seconds
from rallyline.operators import episodes, intervals, ordered, quality, rosters
from rallyline.operators.rosters import GAME, KEYS, PLAYER
from rallyline.session import durable
from rallyline.sources import payloads
from rallyline.sources.warehouse import Warehouse

PLAYS = episodes.Plays(GAME, player="player_id")
#: Why a game is quarantined, in the order in which reasons are told.
REASONS = ("minutes_mismatch", "off_court_attribution", "not_five_on_court", "substitution_state", "possession_gate")


class Tables:
    """Named tables that are published together and read again; what is read is what later plans should start from."""

    @classmethod
    def names(cls) -> list[str]:
        return [f.name for f in fields(cls) if f.metadata.get("table", True)]

    def published(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in self.names()}

    def save(self, root: str, house: Warehouse | None = None, more: dict[str, DataFrame] | None = None, games: DataFrame | None = None) -> Warehouse:
        """Publish all tables, and more, in one commit: for these games, and as whole tables where a table has no games.

        A whole table by season keeps other seasons' rows.  house is the warehouse that the tables were made from; games
        are those of the table `games` unless told otherwise.
        """
        house = house or Warehouse.opened(self.games.sparkSession, root)
        tables = self.published() | (more or {})
        for name, df in tables.items():
            if "season" in df.columns and "game" not in df.columns and (old := house.table(name)) is not None:
                kept = old.join(df.select("season").distinct(), "season", "left_anti")
                tables[name] = df.unionByName(kept.select(df.columns))
        return house.publish(tables, self.games.select(*KEYS) if games is None else games, self.checked)

    def checked(self) -> None:
        """What must hold of the rows that were written, or Violation."""

    @classmethod
    def load(cls, spark: SparkSession, root: str):
        """The tables as they are now, all of one version."""
        house = Warehouse.opened(spark, root)
        tables = {name: house.table(name) for name in cls.names()}
        if lacking := [name for name, df in tables.items() if df is None]:
            raise quality.Violation(f"{root} holds no {', '.join(lacking)}")
        return cls(**tables)


@dataclass(frozen=True)
class Season(Tables):
    """Flat inputs: games (the schedule's played ones), events, players and team rows (box score), shots.

    teams holds (season, team, name) of every scheduled game: a team is in the competition before it has played.
    """

    games: DataFrame
    events: DataFrame
    players: DataFrame
    team_rows: DataFrame
    shots: DataFrame
    teams: DataFrame

    @classmethod
    def read(cls, spark: SparkSession, root: str, season: str, only: list[int] | None = None) -> Season:
        """The tables of a payload tree; with `only`, from these games' files of the season and no others."""
        paths = None if only is None else [(season, game) for game in only]
        box = payloads.payloads(spark, root, "Boxscore", payloads.BOX_SCORE, paths)
        scheduled = payloads.games(spark, root, season)
        played = scheduled.where("played")
        return cls(
            payloads.with_box(played if only is None else played.where(F.col("game").isin(only)), box),
            payloads.events(payloads.payloads(spark, root, "PlaybyPlay", payloads.PLAY_BY_PLAY, paths)),
            payloads.players(box),
            payloads.team_rows(box),
            payloads.shots(payloads.payloads(spark, root, "Points", payloads.SHOTS, paths)),
            payloads.teams(scheduled),
        )

    def only(self, chosen: DataFrame) -> Season:
        """The same tables for the games in chosen (season, game)."""
        tables = [getattr(self, name) for name in self.names()]
        return Season(*[t.join(chosen, list(KEYS), "left_semi") if "game" in t.columns else t for t in tables])

    def sound(self, refused: DataFrame) -> Season:
        """The same tables without the games in refused."""
        return self.only(self.games.select(*KEYS).join(refused.select(*KEYS).distinct(), list(KEYS), "left_anti"))


@dataclass(frozen=True)
class Derived(Tables):
    games: DataFrame
    events: DataFrame
    stints: DataFrame
    lineups: DataFrame
    lineup_players: DataFrame
    trips: DataFrame
    possessions: DataFrame
    minutes: DataFrame
    dimension_players: DataFrame
    dimension_teams: DataFrame
    #: What the season's switch is a sum of: each game's mismatched players by raw and by corrected seconds.
    sums: DataFrame
    verdicts: DataFrame
    #: Counts of rows around the joins, told by the plans that write the tables.
    watch: quality.JoinWatch | None = field(default=None, metadata={"table": False}, compare=False)

    def checked(self) -> None:
        if self.watch is not None:
            self.watch.check()


def seconds(season: Season, moves: DataFrame, length: DataFrame) -> DataFrame:
    """Seconds per listed player: raw, corrected for overtime tips, and official (null where the box has none)."""
    rows = season.players.select(*PLAYER, "name", official_seconds(F.col("minutes")).alias("seconds_official"))
    played = rosters.seconds_by_clock(moves, season.players, length, {"seconds_raw": "elapsed", "seconds_candidate": "elapsed_corrected"})
    return rows.join(played, list(PLAYER), "left").fillna(0, ["seconds_raw", "seconds_candidate"])


#: Clock rules that could be applied to substitutions, and their columns.
RULES = {"raw": "elapsed", "tip_shift": "elapsed_corrected", "running_maximum": "elapsed_clamped", "both": "elapsed_both"}


def clock_control(season: Season) -> DataFrame:
    """Rows (season, game, and a count for each of RULES): listed players whose seconds by the rule aren't the official ones.

    What the rules would have changed is measured for all of them at once, before one is chosen; nothing is written.
    """
    events = rosters.corrected(rosters.timed(season.events))
    events = events.withColumn("elapsed_clamped", ordered.running_maximum(F.col("elapsed"), GAME))
    events = events.withColumn("elapsed_both", ordered.running_maximum(F.col("elapsed_corrected"), GAME))
    moves = rosters.transitions(events, season.players)
    played = rosters.seconds_by_clock(moves, season.players, rosters.lengths(events), RULES)
    rows = season.players.select(*PLAYER, official_seconds(F.col("minutes")).alias("official")).join(played, list(PLAYER), "left").fillna(0, list(RULES))
    return rows.groupBy(*KEYS).agg(*[F.count_if(~matches_official(F.col(n), F.col("official"))).alias(n) for n in RULES])


def mismatch_sums(rows: DataFrame) -> DataFrame:
    """Rows (season, game, raw_wrong, candidate_wrong): how many listed players' seconds aren't the official ones."""
    wrong = lambda c: F.sum((~matches_official(F.col(c), F.col("seconds_official"))).cast("long"))
    return rows.groupBy(*KEYS).agg(wrong("seconds_raw").alias("raw_wrong"), wrong("seconds_candidate").alias("candidate_wrong"))


def use_correction(sums: DataFrame) -> DataFrame:
    """Rows (season, use_correction) from the sums of all its games, whenever each of them was built."""
    return quality.season_switch(sums, "raw_wrong", "candidate_wrong", ["season"])


def switched(rows: DataFrame, switch: DataFrame) -> DataFrame:
    """The minutes with seconds_corrected as the season's switch says; one row a season is broadcast."""
    rows = rows.drop("use_correction", "seconds_corrected").join(F.broadcast(switch), "season")
    return rows.withColumn("seconds_corrected", F.when(F.col("use_correction"), F.col("seconds_candidate")).otherwise(F.col("seconds_raw")))


def verdict_of(rows: DataFrame) -> DataFrame:
    """The verdicts with their reasons, in the fixed order, and flag, from the counts behind them."""
    rows = rows.withColumn("reasons", quality.reasons({name: F.col(f"n_{name}") > 0 for name in REASONS}))
    return rows.withColumn("excluded", F.size("reasons") > 0)


def flipped(old: Derived, switch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The minutes and verdicts of games built before the season's switch turned: all else of them doesn't depend on it."""
    chosen = old.sums.join(F.broadcast(switch), "season")
    wrong = chosen.select(*KEYS, F.when(F.col("use_correction"), F.col("candidate_wrong")).otherwise(F.col("raw_wrong")).alias("n_minutes_mismatch"))
    verdicts = old.verdicts.drop("n_minutes_mismatch").join(wrong, list(KEYS))
    return switched(old.minutes, switch).select(old.minutes.columns), verdict_of(verdicts).select(old.verdicts.columns)


def point_differences(season: Season) -> DataFrame:
    """Violations: players and teams whose made shots don't give their official points, over both sides' keys."""
    value = F.when(F.col("playtype") == "FTM", 1).when(F.col("playtype") == "2FGM", 2).when(F.col("playtype") == "3FGM", 3)
    made = season.events.where(value.isNotNull()).withColumn("points", value)
    found = []
    for grain, official in ((["player_id"], season.players), ([], season.team_rows.where("row_kind = 'total'"))):
        keys = [*KEYS, "team", *grain]
        own = made.groupBy(*keys).agg(F.sum("points").alias("points"))
        bad = quality.reconciled(own, official.select(*keys, "points"), keys, "points")
        found.append(bad.select(*KEYS, "team", (F.col("player_id") if grain else F.lit(None).cast("string")).alias("player_id"), "rebuilt", "official"))
    return found[0].unionByName(found[1])


def input_refusals(season: Season) -> DataFrame:
    """Rows (season, game, finding) of games whose inputs break a rule that every later step rests on."""
    events, players = season.events, season.players
    known = season.games.select(*KEYS, "home", "away")
    sides = known.select(*KEYS, F.explode(F.array("home", "away")).alias("team"))
    starters = players.groupBy(*KEYS, "team").agg(F.count_if("is_starter").alias("n"))
    foreign = lambda rows: rows.where("team IS NOT NULL").join(sides, [*KEYS, "team"], "left_anti")
    found = {
        "repeated_position": ordered.repeated_order(events, GAME),
        "score_decreased": ordered.decreases(events, GAME, "points_a").unionByName(ordered.decreases(events, GAME, "points_b")),
        "unknown_play": episodes.unknown_plays(events, PLAYS),
        "third_team": foreign(events).select(*KEYS).unionByName(foreign(players).select(*KEYS)),
        "not_two_teams": sides.join(starters, [*KEYS, "team"], "left_anti"),
        "not_five_starters": starters.where("n <> 5"),
        "repeated_player": players.groupBy(*PLAYER).count().where("count > 1"),
        "substitution_without_team_or_clock": events.where(F.col("playtype").isin(*rosters.SUBSTITUTIONS) & (F.col("team").isNull() | F.col("clock").isNull())),
        "unpaired_substitutions": rosters.unpaired_substitutions(events),
        "no_events": known.join(events, list(KEYS), "left_anti"),
        "points_do_not_reconcile": point_differences(season),
    }
    rows = [bad.select(*KEYS, F.lit(name).alias("finding")) for name, bad in found.items()]
    return functools.reduce(DataFrame.unionByName, rows).join(known.select(*KEYS), list(KEYS), "left_semi").distinct()


def state_refusals(season: Season, events: DataFrame, moves: DataFrame, courts: DataFrame, played: DataFrame, length: DataFrame) -> DataFrame:
    """Rows (season, game, finding) of games whose rebuilt states don't add up.

    Corrected seconds may change players' shares of a team's time, never its sum, and none may be negative.
    """
    sums = played.groupBy(*KEYS, "team").agg(F.sum("seconds_raw").alias("raw"), F.sum("seconds_candidate").alias("candidate"))
    total = played.select(*PLAYER, F.col("seconds_raw").alias("seconds"))
    tips = events.where(rosters.overtime_tip()).join(season.players.select(*PLAYER), list(PLAYER), "left_anti")
    found = {
        "conservation": rosters.conservation(moves, season.players, courts),
        "team_minutes": rosters.team_minutes(total, length),
        "correction_changes_a_team": sums.where("raw <> candidate"),
        "correction_of_unknown_player": tips,
        "negative_seconds": played.where("seconds_candidate < 0 OR seconds_raw < 0"),
    }
    rows = [bad.select(*KEYS, F.lit(name).alias("finding")) for name, bad in found.items()]
    return functools.reduce(DataFrame.unionByName, rows).distinct()


def colliding(units: DataFrame, known: DataFrame | None) -> DataFrame:
    """Rows (lineup_id): identifiers that stand for two units, among these or with those stored already."""
    rows = units.select("lineup_id", "team", "unit")
    rows = rows if known is None else rows.unionByName(known.select("lineup_id", "team", "unit"))
    return rows.distinct().groupBy("lineup_id").count().where("count > 1").select("lineup_id")


def derive(season: Season, refused: list[DataFrame] | None = None, earlier: DataFrame | None = None, known: DataFrame | None = None) -> Derived:
    """The derived tables.  A game that breaks a rule is refused: all of them raise Violation together.

    With a list, such games are left out instead, and the list gets their rows (season, game, finding).  earlier are the
    sums of the seasons' other games, where they have been derived before, and known the lineups that are stored already.
    """

    def turn_away(bad: DataFrame, what: str) -> DataFrame | None:
        bad = durable(bad)
        if refused is None:
            quality.refuse(bad, what)
            return None
        refused.append(bad)
        return None if bad.isEmpty() else bad

    watch = quality.JoinWatch()
    if (bad := turn_away(input_refusals(season), "games refused for their inputs")) is not None:
        season = season.sound(bad)
    events = rosters.corrected(rosters.timed(season.events)).join(season.games.select(*KEYS, "home", "away"), list(KEYS))
    events = durable(events.withColumn("is_team_event", F.col("player_id").isNull() & F.col("team").isNotNull()))
    length = durable(rosters.lengths(events))
    moves = durable(rosters.transitions(events, season.players))
    courts = durable(rosters.court_intervals(moves, season.players))
    played = durable(seconds(season, moves, length))
    if (bad := turn_away(state_refusals(season, events, moves, courts, played, length), "games refused for their states")) is not None:
        season = season.sound(bad)
        drop = lambda df: durable(df.join(bad.select(*KEYS).distinct(), list(KEYS), "left_anti"))
        events, length, moves, courts, played = map(drop, (events, length, moves, courts, played))
    spans = durable(rosters.substitution_spans(events))
    stints = durable(rosters.stints(events, spans, courts, length, season.games))
    if (bad := turn_away(lineup_refusals(stints, known), "lineups share an id")) is not None:
        season = season.sound(bad)
        drop = lambda df: durable(df.join(bad.select(*KEYS).distinct(), list(KEYS), "left_anti"))
        events, length, moves, courts, played, spans, stints = map(drop, (events, length, moves, courts, played, spans, stints))
    sums = durable(mismatch_sums(played))
    switch = use_correction(sums if earlier is None else sums.unionByName(earlier.select(sums.columns)))
    played = durable(switched(played, switch))
    units = lineups(stints)
    shots = durable(episodes.trips(events, PLAYS))
    found = durable(possessions(shots, stints, length))
    suspects = durable(rosters.off_court(events, courts, spans, season.players))
    verdicts = judge(season, spans, moves, courts, played, found, suspects)
    enriched = intervals.segment_index(shots.withColumnRenamed("excluded", "trip_excluded"), spans, KEYS, "pos", "stint")
    enriched = episodes.attach(enriched, found.withColumnRenamed("start_pos", "start").withColumnRenamed("end_pos", "end"), KEYS, "pos")
    flagged = suspects.select(*KEYS, "pos", F.lit(True).alias("_suspect"))
    enriched = watch.left(enriched, flagged, [*KEYS, "pos"], "events and suspects")
    enriched = enriched.withColumn("attribution_suspect", F.coalesce("_suspect", F.lit(False))).drop("_suspect")
    units_at = stints.select(*KEYS, "stint", "lineup_home", "lineup_away")
    enriched = watch.left(enriched, units_at, [*KEYS, "stint"], "events and stints")
    names = Window.partitionBy("player_id").orderBy(F.desc("season"), F.desc("game"))
    people = season.players.select("player_id", "name", "season", "game", F.row_number().over(names).alias("n")).where("n = 1")
    people = people.select("player_id", "name", F.col("season").alias("name_season"))
    return Derived(
        season.games, enriched, stints, units, units.select("lineup_id", "team", F.explode("unit").alias("player_id")), trip_table(shots), found, played,
        people, season.teams, sums, verdicts, watch,
    )


def lineup_refusals(stints: DataFrame, known: DataFrame | None) -> DataFrame:
    """Rows (season, game, finding) of games with a lineup whose identifier stands for another unit as well."""
    sides = F.explode(F.array("lineup_home", "lineup_away")).alias("lineup_id")
    shared = colliding(lineups(stints), known)
    return stints.select(*KEYS, sides).join(shared, "lineup_id", "left_semi").select(*KEYS, F.lit("lineup_collision").alias("finding")).distinct()


def lineups(stints: DataFrame) -> DataFrame:
    """One row per five-player unit: lineup_id, team, unit."""
    sides = F.explode(F.array(*[F.struct(F.col(s).alias("team"), F.col(f"lineup_{s}").alias("lineup_id"), F.col(f"unit_{s}").alias("unit")) for s in ("home", "away")]))
    return stints.select(sides.alias("s")).select("s.lineup_id", "s.team", "s.unit").where("lineup_id IS NOT NULL").distinct()


def trip_table(shots: DataFrame) -> DataFrame:
    """One row per free-throw trip: its shooter, positions, size, makes, and whether it is an and-one or left out of possessions."""
    rows = shots.where("trip IS NOT NULL").groupBy(*KEYS, "trip")
    return rows.agg(
        F.first("team").alias("team"), F.first("player_id").alias("player_id"), F.min("pos").alias("start_pos"), F.max("pos").alias("end_pos"),
        F.count("*").alias("size"), F.count_if(F.col("playtype") == "FTM").alias("made"), F.max("and_one").alias("and_one"),
        F.max("excluded").alias("excluded"), F.max("trip_long").alias("long"),
    )


def possessions(events: DataFrame, stints: DataFrame, length: DataFrame) -> DataFrame:
    """Possessions with their stint, units, margin (offence's view, score filled at the start row) and time left (raw)."""
    found = episodes.possessions(events, PLAYS).withColumnRenamed("start", "start_pos").withColumnRenamed("end", "end_pos")
    at = events.select(*KEYS, F.col("pos").alias("start_pos"), "elapsed", "score_a", "score_b", "home", "away")
    rows = found.join(at, [*KEYS, "start_pos"]).join(length, list(KEYS))
    inside = stints.select(*KEYS, "stint", F.col("start_pos").alias("s0"), F.col("end_pos").alias("s1"), "lineup_home", "lineup_away")
    # stints cover a game from its first row to its last, so each possession begins in the one that began last
    rows = intervals.latest_begun(rows, inside, KEYS, "start_pos", "s0", "_in").select("*", "_in.*").drop("_in")
    at_home = F.col("team") == F.col("home")
    margin = F.when(at_home, F.col("score_a") - F.col("score_b")).otherwise(F.col("score_b") - F.col("score_a"))
    return rows.select(
        *KEYS, "possession_index", "team", F.when(at_home, F.col("away")).otherwise(F.col("home")).alias("opponent"), "period",
        "start_pos", "end_pos", "end_reason", F.col("points").alias("points"), "stint",
        F.when(at_home, F.col("lineup_home")).otherwise(F.col("lineup_away")).alias("offense_lineup"),
        F.when(at_home, F.col("lineup_away")).otherwise(F.col("lineup_home")).alias("defense_lineup"),
        margin.alias("margin_at_start"), (F.col("game_length") - F.col("elapsed")).alias("seconds_remaining_raw"),
        (F.col("end_pos") > F.col("s1")).alias("straddles"),
    )


def judge(season: Season, spans: DataFrame, moves: DataFrame, courts: DataFrame, played: DataFrame, found: DataFrame, suspects: DataFrame) -> DataFrame:
    """One row per game: excluded, reasons in their fixed order, and the counts behind them."""
    wrong = played.where(~matches_official(F.col("seconds_corrected"), F.col("seconds_official")))
    named = found.withColumnRenamed("opponent", "other")
    gate = episodes.possession_gate(named, PLAYS, season.games.select(*KEYS, "home", "away"))
    parts = {
        "minutes_mismatch": wrong,
        "off_court_attribution": suspects,
        "not_five_on_court": rosters.not_five(courts, spans, season.games),
        "substitution_state": rosters.state_issues(moves),
        "possession_gate": gate,
    }
    assert tuple(parts) == REASONS
    rows = season.games.select(*KEYS)
    for name, bad in parts.items():
        rows = rows.join(bad.groupBy(*KEYS).agg(F.count("*").alias(f"n_{name}")), list(KEYS), "left").fillna(0, [f"n_{name}"])
    return verdict_of(rows)
