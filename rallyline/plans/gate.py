"""The gate: every invariant between a season's inputs and its derived tables, as one table of violations.

Each check is a plan whose rows are violations, so an empty gate is a sound warehouse.  Quarantined games are held to
everything but what their own reasons name.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyline.operators import quality, rosters
from rallyline.operators.rosters import KEYS
from rallyline.plans.season import REASONS, Derived, Season

#: Columns of an event that deriving must not change.
PAYLOAD = ("playtype", "team", "player_id", "clock", "period", "number")
SHOTS = ("2FGM", "2FGA", "3FGM", "3FGA")


def counts(s: Season, d: Derived) -> dict[str, DataFrame]:
    """Games against verdicts, and events of each game against derived ones."""
    return {
        "games_and_verdicts": quality.count_differences(s.games, d.verdicts, list(KEYS)),
        "events_of_a_game": quality.count_differences(s.events, d.events, list(KEYS)),
    }


def identity(s: Season, d: Derived) -> dict[str, DataFrame]:
    """Events that one side lacks or that differ: one join on the key, compared null-safely."""
    raw = s.events.select(*KEYS, "pos", F.struct(*PAYLOAD).alias("raw"), F.lit(True).alias("in_raw"))
    own = d.events.select(*KEYS, "pos", F.struct(*PAYLOAD).alias("own"), F.lit(True).alias("in_own"))
    both = raw.join(own, [*KEYS, "pos"], "full_outer")
    return {
        "event_of_one_side": both.where("in_raw IS NULL OR in_own IS NULL"),
        "event_changed": both.where(F.col("in_raw") & F.col("in_own") & ~F.col("raw").eqNullSafe(F.col("own"))),
    }


def shots_when_loaded(s: Season) -> dict[str, DataFrame]:
    """Field goals of the stream against the shot feed's, for games that have a feed; others are simply not loaded."""
    is_shot = lambda c: F.col(c).isin(*SHOTS)
    feed = s.shots.where(is_shot("action")).groupBy(*KEYS).agg(F.count("*").alias("feed"))
    loaded = s.shots.select(*KEYS).distinct()
    stream = s.events.where(is_shot("playtype")).groupBy(*KEYS).agg(F.count("*").alias("stream"))
    both = loaded.join(stream, list(KEYS), "left").join(feed, list(KEYS), "left").fillna(0, ["stream", "feed"])
    return {"shots_of_a_game": both.where("stream <> feed")}


def states(s: Season, d: Derived) -> dict[str, DataFrame]:
    """Units, stints, possessions and minutes against each other."""
    sides = F.explode(F.array(F.struct(F.col("home").alias("team"), F.col("lineup_home").alias("lineup_id")), F.struct(F.col("away").alias("team"), F.col("lineup_away").alias("lineup_id"))))
    used = d.stints.select(*KEYS, sides.alias("s")).select(*KEYS, "s.*").where("lineup_id IS NOT NULL")
    along = Window.partitionBy(*KEYS).orderBy("stint")
    chain = d.stints.withColumn("next_pos", F.lead("start_pos").over(along)).withColumn("next_at", F.lead("start_at").over(along))
    of = d.possessions.select(*KEYS, "stint", "possession_index", F.explode(F.array("offense_lineup", "defense_lineup")).alias("lineup_id"))
    at = d.stints.select(*KEYS, "stint", F.explode(F.array("lineup_home", "lineup_away")).alias("lineup_id"))
    length = rosters.lengths(s.events)
    seconds = d.minutes.select(*KEYS, "team", F.col("seconds_corrected").alias("seconds"))
    return {
        "unit_size": d.lineups.where(F.size("unit") != 5).select(F.lit(None).cast("string").alias("season"), F.lit(None).cast("int").alias("game")),
        "stint_without_lineup": used.join(d.lineups, ["lineup_id", "team"], "left_anti"),
        "lineup_never_on": d.lineups.join(used.select("lineup_id").distinct(), "lineup_id", "left_anti").select(F.lit(None).cast("string").alias("season"), F.lit(None).cast("int").alias("game")),
        "stint_gap": chain.where("next_pos <> end_pos + 1 OR next_at <> end_at"),
        # a possession's units are the two of the stint that it began in
        "possession_of_other_units": of.where("lineup_id IS NOT NULL").join(at, [*KEYS, "stint", "lineup_id"], "left_anti"),
        "possession_order": d.possessions.where("end_pos < start_pos"),
        "team_minutes": rosters.team_minutes(seconds, length),
    }


def verdicts(d: Derived) -> dict[str, DataFrame]:
    """A verdict's flag, its reasons and their order against the counts behind them."""
    again = quality.reasons({name: F.col(f"n_{name}") > 0 for name in REASONS})
    return {"verdict": quality.reason_mismatches(d.verdicts, "excluded", "reasons", again)}


def hashes(index: DataFrame, column: str = "sha256") -> DataFrame:
    """Violations: entries whose hash hasn't the shape of one."""
    return index.where(~F.coalesce(F.col(column).rlike("^[0-9a-f]{64}$"), F.lit(False)))


def violations(s: Season, d: Derived) -> DataFrame:
    """Rows (gate, season, game, n): how often each invariant is broken, by game; no rows in a sound warehouse."""
    every = counts(s, d) | identity(s, d) | shots_when_loaded(s) | states(s, d) | verdicts(d)
    rows = [bad.select(F.lit(name).alias("gate"), *KEYS) for name, bad in every.items()]
    return functools.reduce(DataFrame.unionByName, rows).groupBy("gate", *KEYS).agg(F.count("*").alias("n"))


def lineup_collisions(d: Derived, bits: int = 128) -> float:
    """The chance that the lineups' identifiers of so many bits aren't all different, were they random."""
    return quality.collision_probability(d.lineups.count(), bits)


def excused(found: DataFrame, d: Derived, unless: Column | None = None) -> DataFrame:
    """The violations of games that aren't quarantined, or for which `unless` holds."""
    out = d.verdicts.where("excluded").select(*KEYS)
    keep = found.join(out, list(KEYS), "left_anti")
    return keep if unless is None else keep.unionByName(found.where(unless).join(out, list(KEYS), "left_semi"))
