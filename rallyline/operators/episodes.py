"""Free-throw trips and possessions from an ordered stream of plays, as windows and groups.

The sequential rules need no loop: a possession is an island between closing effects of its team.  Each ball row is
expanded into effects (the team's own touch; for a defensive rebound also a close for the other team), and the number
of closes before an effect numbers the islands of (stream, team, period).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rallyline.operators.ordered import Stream, previous_known
from rallyline.session import durable

#: The play vocabulary by role.
ENDING = ("2FGM", "3FGM", "TO", "D", "FTM")
CONTINUING = ("2FGA", "3FGA", "FTA", "O")
NO_BALL = ("IN", "OUT", "RV", "CM", "AS", "TOUT", "TOUT_TV", "FV", "AG", "ST", "CCH", "OF", "CMU", "CMT", "C", "B",
           "CMD", "CMTI", "BP", "EP", "EG", "JB")
FOULS = ("CM", "OF", "CMU", "CMT", "C", "B", "CMD", "CMTI")
RETAINING = ("CMT", "C", "B", "CMU")
FREE_THROWS = ("FTM", "FTA")
FIELD_GOALS = {"2FGM": 2, "3FGM": 3}


@dataclass(frozen=True)
class Plays:
    """Column names of a play stream."""

    stream: Stream
    play: str = "playtype"
    team: str = "team"
    player: str = "player"
    period: str = "period"
    home: str = "home"
    away: str = "away"


def _columns(plays: Plays) -> list[str]:
    """The columns of a play stream that possessions come from."""
    named = (*plays.stream.keys, plays.stream.order, plays.play, plays.team, plays.player, plays.period, plays.home, plays.away)
    return list(dict.fromkeys(named))


def unknown_plays(df: DataFrame, plays: Plays) -> DataFrame:
    """Violations: rows whose play isn't in the vocabulary."""
    return df.where(~F.coalesce(F.col(plays.play), F.lit("")).isin(*ENDING, *CONTINUING, *NO_BALL))


def trips(df: DataFrame, plays: Plays, longest: int = 3) -> DataFrame:
    """Adds trip, trip_position, trip_size, trip_long and excluded to free-throw rows (null on others).

    A trip is a run of free throws by one shooter that no ball-touching row or foul parts.  Its shots are excluded from
    possessions where it is an and-one (the ball row before its first shot is a field goal made by the same player), or
    where a foul that leaves the ball with the team stands between that ball row and the first shot.
    """
    s, play, player, team = plays.stream, F.col(plays.play), F.col(plays.player), F.col(plays.team)
    free, ball, foul = play.isin(*FREE_THROWS), play.isin(*ENDING, *CONTINUING), play.isin(*FOULS)
    kept = F.when(ball | foul, F.struct(free.alias("free"), player.alias("player")))
    rows = df.withColumn("_free", free).withColumn("_before", previous_known(kept, s))
    same = F.coalesce(F.col("_before.free"), F.lit(False)) & F.col("_before.player").eqNullSafe(player)
    rows = rows.withColumn("_first", F.col("_free") & ~same)
    rows = rows.withColumn("_trip", F.sum(F.col("_first").cast("int")).over(s.so_far))
    # what stands between the last ball row and this one is told by positions, so that all of it is the stream's own window
    at = F.col(s.order)
    last_ball = previous_known(F.when(ball, F.struct(play.alias("p"), team.alias("t"), player.alias("n"), at.alias("at"))), s)
    last_foul = previous_known(F.when(play.isin(*RETAINING), at), s)
    rows = rows.withColumn("_ball", last_ball).withColumn("_foul", last_foul)
    retained = F.col("_foul").isNotNull() & (F.col("_ball.at").isNull() | (F.col("_foul") > F.col("_ball.at")))
    and_one = (
        F.col("_ball.p").isin(*FIELD_GOALS) & F.col("_ball.t").eqNullSafe(team) & F.col("_ball.n").eqNullSafe(player)
    )
    told = F.struct(F.coalesce(and_one, F.lit(False)).alias("and_one"), retained.alias("retained"), F.col("_nth").alias("nth"))
    rows = rows.withColumn("_nth", F.sum(F.col("_free").cast("int")).over(s.so_far))
    rows = rows.withColumn("_start", F.last(F.when(F.col("_first"), told), ignorenulls=True).over(s.so_far))
    # the next trip's first number, or the stream's last, tells a trip's size: a look ahead in the reversed order
    ahead = Window.partitionBy(*s.keys).orderBy(F.col(s.order).desc()).rowsBetween(Window.unboundedPreceding, -1)
    next_nth = F.last(F.when(F.col("_first"), F.col("_nth")), ignorenulls=True).over(ahead)
    rows = rows.withColumn("_next", F.coalesce(next_nth, F.max("_nth").over(s.whole) + 1))
    rows = rows.withColumn("trip_position", F.when(F.col("_free"), (F.col("_nth") - F.col("_start.nth") + 1).cast("int")))
    rows = rows.withColumn("trip_size", F.when(F.col("_free"), F.col("_next") - F.col("_start.nth")))
    rows = rows.withColumn("and_one", F.when(F.col("_free"), F.col("_start.and_one")))
    rows = rows.withColumn("excluded", F.when(F.col("_free"), F.col("_start.and_one") | F.col("_start.retained")))
    rows = rows.withColumn("trip", F.when(F.col("_free"), F.col("_trip")))
    rows = rows.withColumn("trip_long", F.col("trip_size") > longest)
    return rows.drop("_free", "_before", "_first", "_trip", "_ball", "_foul", "_nth", "_start", "_next")


def possessions(df: DataFrame, plays: Plays) -> DataFrame:
    """Rows (keys, possession_index, team, period, start, end, end_reason, points), from rows of a play stream.

    Rows that `trips` has been through already are taken as they are.
    """
    s, play, team, order = plays.stream, F.col(plays.play), F.col(plays.team), plays.stream.order
    # written, since both the possessions and the and-ones start from it
    rows = df if "trip_size" in df.columns else durable(trips(df.select(*_columns(plays)), plays))
    free, ball = play.isin(*FREE_THROWS), play.isin(*ENDING, *CONTINUING)
    out = F.coalesce(F.col("excluded"), F.lit(False))
    rows = rows.withColumn("_out", out).withColumn("_after_out", F.coalesce(previous_known(F.when(ball, out), s), F.lit(False)))
    rows = rows.withColumn("_last", F.max(order).over(s.within(plays.period).whole))
    points = F.when(play == "FTM", 1)
    for code, n in FIELD_GOALS.items():
        points = points.when(play == code, n)
    reason = F.when(play.isin(*FIELD_GOALS), "made_shot").when(play == "TO", "turnover")
    reason = reason.when((play == "FTM") & (F.col("trip_position") == F.col("trip_size")), "made_free_throw")
    touch = F.struct(team.alias("who"), F.coalesce(points, F.lit(0)).alias("points"), reason.alias("reason"))
    other = F.when(team == F.col(plays.home), F.col(plays.away)).otherwise(F.col(plays.home))
    lost = F.struct(other.alias("who"), F.lit(0).alias("points"), F.lit("defensive_rebound").alias("reason"))
    effects = F.when((play == "D") & ~F.col("_after_out"), F.array(touch, lost)).otherwise(F.array(touch))
    counted = rows.where(ball & ~(free & F.col("_out")))
    counted = counted.select(*s.keys, order, F.col(plays.period).alias("period"), "_last", F.explode(effects).alias("e"))
    counted = counted.select(*s.keys, order, "period", "_last", "e.*")
    by_team = Stream((*s.keys, "who", "period"), order)
    closes = F.coalesce(F.count("reason").over(by_team.before), F.lit(0))
    found = counted.withColumn("_n", closes).groupBy(*s.keys, "who", "period", "_n").agg(
        F.min(order).alias("start"),
        F.coalesce(F.max(F.when(F.col("reason").isNotNull(), F.col(order))), F.max("_last")).alias("end"),
        F.coalesce(F.max("reason"), F.lit("end_of_period")).alias("end_reason"),
        F.sum("points").alias("points"),
    )
    found = _with_and_ones(found, rows, plays)
    numbered = Stream(s.keys, "end").whole.orderBy("end", "start", "who")
    return found.select(
        *s.keys, (F.row_number().over(numbered) - 1).alias("possession_index"), F.col("who").alias("team"), "period",
        "start", "end", "end_reason", F.col("points").cast("long").alias("points"),
    )


def _with_and_ones(found: DataFrame, rows: DataFrame, plays: Plays) -> DataFrame:
    """Adds each and-one make to its team's latest possession that closed before it: one ordered pass over both."""
    s, order = plays.stream, plays.stream.order
    extra = rows.where(F.col("_out") & F.col("and_one") & (F.col(plays.play) == "FTM")).select(
        *s.keys, F.col(plays.team).alias("who"), F.col(order).alias("end"), F.lit(1).alias("_extra")
    )
    both = found.withColumn("_extra", F.lit(0)).unionByName(extra, allowMissingColumns=True)
    at = Stream((*s.keys, "who"), "end").whole.orderBy("end", "_extra", "start")
    both = both.withColumn("_to", F.sum(1 - F.col("_extra")).over(at.rowsBetween(Window.unboundedPreceding, 0)))
    gained = F.sum("_extra").over(Stream((*s.keys, "who", "_to"), "end").whole)
    both = both.withColumn("points", F.col("points") + gained)
    return both.where("_extra = 0").drop("_extra", "_to")


def off_possession_points(df: DataFrame, plays: Plays) -> DataFrame:
    """Rows (keys, team, points): excluded free throws made that belong to no possession (no and-ones)."""
    made = trips(df, plays).where(F.col("excluded") & ~F.col("and_one") & (F.col(plays.play) == "FTM"))
    return made.groupBy(*plays.stream.keys, F.col(plays.team).alias("team")).agg(F.count("*").alias("points"))


def attach(events: DataFrame, found: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """Adds possession_index to each event: the lowest one that covers it, null where none does.

    Possessions of one team don't overlap, so what can cover an event is the last one of either team that began up to
    it: one ordered pass over events and beginnings, whatever the number of either.
    """
    one = F.min("team").over(Window.partitionBy(*keys))
    begun = found.withColumn("_one", F.col("team") == one).select(
        *keys, F.col("start").alias(order), "_one", F.struct("end", "possession_index").alias("_span")
    )
    both = events.withColumn("_event", F.lit(1)).unionByName(begun.withColumn("_event", F.lit(0)), allowMissingColumns=True)
    so_far = Window.partitionBy(*keys).orderBy(order, "_event").rowsBetween(Window.unboundedPreceding, 0)
    for side, is_side in (("_a", F.col("_one")), ("_b", ~F.col("_one"))):
        both = both.withColumn(side, F.last(F.when(is_side, F.col("_span")), ignorenulls=True).over(so_far))
    covers = [F.when(F.col(f"{s}.end") >= F.col(order), F.col(f"{s}.possession_index")) for s in ("_a", "_b")]
    # least() passes over nulls
    rows = both.withColumn("possession_index", F.least(*covers)).where("_event = 1")
    return rows.select(*events.columns, "possession_index")


def possession_gate(found: DataFrame, plays: Plays, sides: DataFrame, most: int = 2) -> DataFrame:
    """Streams whose two teams' possession counts differ by more than `most`: rows (keys, n_home, n_away)."""
    keys = plays.stream.keys
    counts = found.join(sides, list(keys)).groupBy(*keys).agg(
        F.count_if(F.col("team") == F.col(plays.home)).alias("n_home"),
        F.count_if(F.col("team") == F.col(plays.away)).alias("n_away"),
    )
    return counts.where(F.abs(F.col("n_home") - F.col("n_away")) > most)
