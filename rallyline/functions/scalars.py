"""Scalar rules of the domain as Column functions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed(text: Column) -> Column:
    """White space off both ends, and null where nothing is left."""
    cut = F.regexp_replace(text.cast("string"), r"^\s+|\s+$", "")
    return F.nullif(cut, F.lit(""))


def integer_or_null(text: Column) -> Column:
    """Null and '' are null; anything else must be an integer, or the query fails."""
    return F.nullif(text.cast("string"), F.lit("")).cast("int")


def at_or_null(text: Column) -> Column:
    return F.nullif(text.cast("string"), F.lit("")).cast("long")


def strict_boolean(text: Column) -> Column:
    low = F.lower(text.cast("string"))
    wrong = F.raise_error(F.concat(F.lit("not a boolean: "), F.coalesce(low, F.lit("null")))).cast("boolean")
    return F.when(low.isin("1", "true"), True).when(low.isin("0", "false"), False).otherwise(wrong)


def countdown_seconds(clock: Column) -> Column:
    """'MM:SS' in seconds; null without a colon or with parts that are no integers."""
    parts = F.split(trimmed(clock), ":", 2)
    minutes, seconds = (F.get(parts, F.lit(i)).try_cast("int") for i in (0, 1))
    return minutes * 60 + seconds


def official_seconds(minutes: Column) -> Column:
    text = trimmed(minutes)
    return F.when(F.upper(text) == "DNP", None).otherwise(countdown_seconds(text))


def matches_official(rebuilt: Column, official: Column) -> Column:
    return F.when(official.isNull(), rebuilt == 0).otherwise(rebuilt == official)


def elapsed_seconds(period: Column, play: Column, clock: Column, quarter: int = 600, overtime: int = 300) -> Column:
    """Seconds since the start that a row itself tells: from its clock, or from a period's begin or end; else null."""
    length = F.when(period <= 4, quarter).otherwise(overtime)
    start = F.when(period <= 4, (period - 1) * quarter).otherwise(4 * quarter + (period - 5) * overtime)
    left = countdown_seconds(clock)
    return (
        F.when(left.isNotNull(), start + length - left)
        .when(play == "BP", start)
        .when(play.isin("EP", "EG"), start + length)
    )


def game_seconds(last_period: Column, quarter: int = 600, overtime: int = 300) -> Column:
    return 4 * quarter + overtime * F.greatest(last_period - 4, F.lit(0))


def lineup_hash(team: Column, players: Column) -> Column:
    """32 hex digits of SHA-256 over the team and the players, joined by zero characters."""
    return F.substring(F.sha2(F.concat_ws("\0", team, players), 256), 1, 32)


#: Shot types by action code.
SHOT_TYPES = {"2FGM": "2P", "2FGA": "2P", "3FGM": "3P", "3FGA": "3P", "FTM": "FT", "FTA": "FT"}


def shot_type(action: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in SHOT_TYPES.items() for x in pair]), action)


def shot_made(action: Column) -> Column:
    return F.when(action.isin(*SHOT_TYPES), action.endswith("M"))


def real_coordinate(x: Column, y: Column, value: Column) -> Column:
    """The value, or null where both coordinates are the sentinel -1 or one is missing."""
    return F.when(x.isNotNull() & y.isNotNull() & ~((x == -1) & (y == -1)), value)


def winner(home: Column, away: Column, home_score: Column, away_score: Column) -> Column:
    return F.when(home_score > away_score, home).when(away_score > home_score, away)


def ratio(a: Column, b: Column) -> Column:
    """A ratio of sums as a double, null where the divisor is zero."""
    return a.cast("double") / F.nullif(b, F.lit(0)).cast("double")


def rate(a: Column, b: Column, digits: int, times: int = 1) -> Column:
    """A ratio of exact numbers, rounded half away from zero as a decimal."""
    return F.round(a.cast("decimal(20,4)") * times / F.nullif(b, F.lit(0)).cast("decimal(20,4)"), digits)


def net_rate(points: Column, possessions: Column, against: Column, possessions_against: Column) -> Column:
    """Points for less points against, each for 100 possessions, rounded once."""
    share = lambda a, b: a.cast("decimal(20,4)") * 100 / F.nullif(b, F.lit(0)).cast("decimal(20,4)")
    return F.round(share(points, possessions) - share(against, possessions_against), 2)


def effective_field_goals(made: Column, threes: Column, tried: Column) -> Column:
    return rate(made + F.lit(0.5).cast("decimal(2,1)") * threes, tried, 4)


def name_like(name: Column, wanted: str) -> Column:
    """Case-blind containment; % and _ in the wanted name are wildcards, as in the query surface this follows."""
    return name.ilike(f"%{wanted}%")


def squared_distance(x: Column, y: Column) -> Column:
    return x * x + y * y


def corner_three(x: Column, y: Column) -> Column:
    """Whether a shot is beside the straight part of the three-point line (660 cm out, arc of 675 cm)."""
    return (F.abs(x) >= 660) & (y * y <= 675 * 675 - 660 * 660)
