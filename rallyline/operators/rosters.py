"""On-court state from substitutions: intervals, minutes, five-player checks, attribution, stints and units.

State is last write wins: a player who is set on again stays on, and the repeat is an issue.  Transitions become
intervals of positions, and later questions are answered by ordered passes over questions and intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyline.functions.scalars import elapsed_seconds, game_seconds, lineup_hash
from rallyline.operators import intervals
from rallyline.operators.ordered import Stream, forward_fill, islands, moved_backwards, running_state

GAME = Stream(("season", "game"), "pos")
KEYS = ("season", "game")
PLAYER = ("season", "game", "team", "player_id")
SUBSTITUTIONS = ("IN", "OUT")


def timed(events: DataFrame) -> DataFrame:
    """Adds elapsed (raw seconds), clock_backwards, and the filled score; a row without a time keeps the last one."""
    own = elapsed_seconds(F.col("period"), F.col("playtype"), F.col("clock"))
    rows = events.withColumn("_own", own).withColumn("elapsed", forward_fill(F.col("_own"), GAME, 0)).drop("_own")
    rows = rows.withColumn("clock_backwards", moved_backwards(F.col("elapsed"), GAME))
    for side in ("a", "b"):
        rows = rows.withColumn(f"score_{side}", forward_fill(F.col(f"points_{side}"), GAME, 0))
    return rows


def overtime_tip() -> Column:
    """Whether a row is a substitution stamped at an overtime's very tip."""
    return (F.col("period") >= 5) & F.col("playtype").isin(*SUBSTITUTIONS) & F.coalesce(F.col("clock") == "05:00", F.lit(False))


def corrected(events: DataFrame) -> DataFrame:
    """Adds elapsed_corrected: substitutions stamped at an overtime's very tip count a minute later."""
    return events.withColumn("elapsed_corrected", F.col("elapsed") + F.when(overtime_tip(), 60).otherwise(0))


def lengths(events: DataFrame) -> DataFrame:
    return events.groupBy(*KEYS).agg(game_seconds(F.max("period")).alias("game_length"))


def substitution_spans(events: DataFrame) -> DataFrame:
    """Merged spans of positions of each game in which substitutions at one clock reading take place."""
    subs = events.where(F.col("playtype").isin(*SUBSTITUTIONS))
    return intervals.merged(intervals.spans_of(subs, KEYS, ("period", "team", "clock"), "pos"), KEYS)


def unpaired_substitutions(events: DataFrame) -> DataFrame:
    """Violations: (period, team, clock) batches with unequal numbers of players in and out."""
    subs = events.where(F.col("playtype").isin(*SUBSTITUTIONS)).groupBy(*KEYS, "period", "team", "clock")
    counts = subs.agg(F.count_if(F.col("playtype") == "IN").alias("n_in"), F.count_if(F.col("playtype") == "OUT").alias("n_out"))
    return counts.where("n_in <> n_out")


def transitions(events: DataFrame, players: DataFrame) -> DataFrame:
    """Substitution rows with state, was, changed and issue for their player."""
    starters = players.select(*PLAYER, F.col("is_starter").alias("_starts"))
    subs = events.where(F.col("playtype").isin(*SUBSTITUTIONS)).join(starters, list(PLAYER), "left")
    stream = Stream(PLAYER, "pos")
    first = F.coalesce(F.col("_starts"), F.lit(False))
    return running_state(subs, stream, F.col("playtype") == "IN", F.col("playtype") == "OUT", first).drop("_starts")


def court_intervals(moves: DataFrame, players: DataFrame, clock: str = "elapsed") -> DataFrame:
    """Rows (season, game, team, player_id, enter_pos, exit_pos, enter_at, exit_at); starters enter at -1, open exits are null."""
    moved = moves.where("changed").select(*PLAYER, "pos", F.col(clock).alias("at"), "state")
    begun = players.where("is_starter").select(*PLAYER, F.lit(-1).alias("pos"), F.lit(0).alias("at"), F.lit(True).alias("state"))
    order = Window.partitionBy(*PLAYER).orderBy("pos")
    rows = moved.unionByName(begun).withColumn("exit_pos", F.lead("pos").over(order)).withColumn("exit_at", F.lead("at").over(order))
    return rows.where("state").select(*PLAYER, F.col("pos").alias("enter_pos"), "exit_pos", F.col("at").alias("enter_at"), "exit_at")


def seconds_played(courts: DataFrame, length: DataFrame) -> DataFrame:
    rows = courts.join(length, list(KEYS)).withColumn("s", F.coalesce("exit_at", "game_length") - F.col("enter_at"))
    return rows.groupBy(*PLAYER).agg(F.sum("s").cast("int").alias("seconds"))


def seconds_by_clock(moves: DataFrame, players: DataFrame, length: DataFrame, clocks: dict[str, str]) -> DataFrame:
    """Rows (player, and a column of seconds for each name in clocks): what each clock column of the moves would give.

    One pass over one set of moves for all clocks: a player's times on the floor begin and end at the same rows by any.
    """
    at = F.struct(*[F.col(clock).cast("int").alias(name) for name, clock in clocks.items()]).alias("at")
    zero = F.struct(*[F.lit(0).alias(name) for name in clocks]).alias("at")
    moved = moves.where("changed").select(*PLAYER, "pos", at, "state")
    begun = players.where("is_starter").select(*PLAYER, F.lit(-1).alias("pos"), zero, F.lit(True).alias("state"))
    rows = moved.unionByName(begun).withColumn("until", F.lead("at").over(Window.partitionBy(*PLAYER).orderBy("pos")))
    rows = rows.where("state").join(length, list(KEYS))
    each = [F.sum(F.coalesce(F.col(f"until.{n}"), F.col("game_length")) - F.col(f"at.{n}")).cast("int").alias(n) for n in clocks]
    return rows.groupBy(*PLAYER).agg(*each)


def on_court(courts: DataFrame, at: DataFrame, pos: str) -> DataFrame:
    """Players on the floor after each position: at's rows joined with (team, player_id)."""
    spans = courts.select(*PLAYER, "enter_pos", "exit_pos")
    return intervals.covering(at, spans, KEYS, pos, "enter_pos", "exit_pos", closed=False).drop("enter_pos", "exit_pos")


def not_five(courts: DataFrame, spans: DataFrame, games: DataFrame) -> DataFrame:
    """Violations: (season, game, end, team, n) where a team hasn't five players after a substitution span."""
    sides = games.select(*KEYS, F.explode(F.array("home", "away")).alias("team"))
    counts = on_court(courts, spans.select(*KEYS, "end"), "end").groupBy(*KEYS, "end", "team").agg(F.count("*").alias("n"))
    every = spans.select(*KEYS, "end").join(sides, list(KEYS))
    return every.join(counts, [*KEYS, "end", "team"], "left").fillna(0, ["n"]).where("n <> 5")


def off_court(events: DataFrame, courts: DataFrame, spans: DataFrame, players: DataFrame) -> DataFrame:
    """Violations: plays of listed players who aren't on the floor at any time of the play's clock run or span."""
    runs = islands(events, GAME, "run", F.col("period"), F.col("clock"))
    whole = Window.partitionBy(*KEYS, "run")
    runs = runs.withColumn("ws", F.min("pos").over(whole)).withColumn("we", F.max("pos").over(whole))
    plays = runs.where(~F.col("playtype").isin(*SUBSTITUTIONS)).join(players.select(*PLAYER), list(PLAYER), "left_semi")
    # merged spans don't overlap, and neither do one player's times on the floor
    plays = intervals.latest_begun(plays, spans.select(*KEYS, "start", "end"), KEYS, "pos", "start", "span")
    within = F.col("span.end") >= F.col("pos")
    plays = plays.withColumn("ws", F.least("ws", F.when(within, F.col("span.start")))).withColumn("we", F.greatest("we", F.when(within, F.col("span.end")))).drop("span")
    plays = intervals.latest_begun(plays, courts.select(*PLAYER, "enter_pos", "exit_pos"), PLAYER, "we", "enter_pos", "on")
    seen = F.col("on").isNotNull() & (F.col("on.exit_pos").isNull() | (F.col("on.exit_pos") >= F.col("ws")))
    return plays.where(~seen).drop("on")


def state_issues(moves: DataFrame) -> DataFrame:
    return moves.where("issue").select(*PLAYER, "pos", "playtype")


def conservation(moves: DataFrame, players: DataFrame, courts: DataFrame) -> DataFrame:
    """Violations: players for whom starting plus entering isn't leaving plus ending on the floor (changed rows alone)."""
    counts = moves.where("changed").groupBy(*PLAYER).agg(
        F.count_if(F.col("playtype") == "IN").alias("n_in"), F.count_if(F.col("playtype") == "OUT").alias("n_out")
    )
    ended = courts.where("exit_pos IS NULL").groupBy(*PLAYER).agg(F.count("*").alias("ended"))
    rows = players.select(*PLAYER, F.col("is_starter").cast("int").alias("started")).join(counts, list(PLAYER), "left").join(ended, list(PLAYER), "left")
    return rows.fillna(0).where("started + n_in <> n_out + ended")


def team_minutes(seconds: DataFrame, length: DataFrame) -> DataFrame:
    """Violations: teams whose players' seconds don't sum to five times the game."""
    return seconds.groupBy(*KEYS, "team").agg(F.sum("seconds").alias("total")).join(length, list(KEYS)).where("total <> 5 * game_length")


def stints(events: DataFrame, spans: DataFrame, courts: DataFrame, length: DataFrame, games: DataFrame) -> DataFrame:
    """Rows per stable segment: positions, times, scores, and both units with their hashes (null unless five players).

    The rows of a substitution span belong to the stint before it; the next one starts at the time of the span's first
    row with the score after its last.
    """
    rows = intervals.segment_index(events, spans, KEYS, "pos", "stint")
    after = rows.groupBy(*KEYS, "stint").agg(
        F.min("pos").alias("start_pos"), F.max("pos").alias("end_pos"),
        F.max_by("score_a", "pos").alias("score_a"), F.max_by("score_b", "pos").alias("score_b"),
    )
    order = Window.partitionBy(*KEYS).orderBy("start")
    ends = spans.withColumn("stint", F.row_number().over(order)).select(*KEYS, "stint", F.col("start").alias("pos"), F.col("end").alias("after"))
    began = ends.join(events.select(*KEYS, "pos", "elapsed"), [*KEYS, "pos"]).select(*KEYS, "stint", "after", F.col("elapsed").alias("start_at"))
    made = after.join(began, [*KEYS, "stint"], "left").join(length, list(KEYS))
    made = made.withColumn("after", F.coalesce("after", F.lit(-1))).withColumn("start_at", F.coalesce("start_at", F.lit(0)))
    along = Window.partitionBy(*KEYS).orderBy("stint")
    made = made.withColumn("end_at", F.coalesce(F.lead("start_at").over(along), "game_length"))
    for side in ("a", "b"):
        made = made.withColumn(f"points_{side}", F.col(f"score_{side}") - F.coalesce(F.lag(f"score_{side}").over(along), F.lit(0)))
    units = on_court(courts, made.select(*KEYS, "stint", "after"), "after").groupBy(*KEYS, "stint", "team").agg(F.array_sort(F.collect_set("player_id")).alias("unit"))
    units = units.withColumn("lineup_id", F.when(F.size("unit") == 5, lineup_hash(F.col("team"), F.col("unit"))))
    made = made.join(games.select(*KEYS, "home", "away"), list(KEYS))
    for side in ("home", "away"):
        own = units.select(*KEYS, "stint", F.col("team").alias(side), F.col("unit").alias(f"unit_{side}"), F.col("lineup_id").alias(f"lineup_{side}"))
        made = made.join(own, [*KEYS, "stint", side], "left")
    return made.drop("after", "game_length")
