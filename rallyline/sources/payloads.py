"""Nested JSON payloads of a season as flat tables.

A tree <root>/<season>/<endpoint>/<game>.json is read with explicit schemas; season and game come from the path.  The
array position of an event is its only valid order, so it is kept as `pos`.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rallyline.functions.scalars import integer_or_null, strict_boolean, trimmed
from rallyline.operators.ordered import Stream

#: Payload fields as the source spells them.
PERIODS = ("FirstQuarter", "SecondQuarter", "ThirdQuarter", "ForthQuarter", "ExtraTime")
STATISTICS = (
    "Points", "FieldGoalsMade2", "FieldGoalsAttempted2", "FieldGoalsMade3", "FieldGoalsAttempted3", "FreeThrowsMade",
    "FreeThrowsAttempted", "OffensiveRebounds", "DefensiveRebounds", "TotalRebounds", "Assistances", "Steals",
    "Turnovers", "BlocksFavour", "BlocksAgainst", "FoulsCommited", "FoulsReceived", "Valuation",
)
_EVENT = "struct<NUMBEROFPLAY: int, PLAYTYPE: string, PLAYER_ID: string, CODETEAM: string, MARKERTIME: string, MINUTE: int, POINTS_A: string, POINTS_B: string>"
PLAY_BY_PLAY = ", ".join(f"{p} array<{_EVENT}>" for p in PERIODS)
_STATS = ", ".join(f"{s}: int" for s in STATISTICS)
_PLAYER = f"struct<Player_ID: string, IsStarter: string, IsPlaying: string, Team: string, Dorsal: string, Player: string, Minutes: string, Plusminus: int, {_STATS}>"
_TEAM = f"struct<Team: string, Minutes: string, {_STATS}>"
BOX_SCORE = f"Live boolean, Referees string, Attendance string, Stats array<struct<Team: string, Coach: string, PlayersStats: array<{_PLAYER}>, tmr: {_TEAM}, totr: {_TEAM}>>"
_CLUB = "struct<score: int, club: struct<code: string, name: string>>"
_NAMED = "struct<code: string, name: string>"
SCHEDULE = (
    "data array<struct<gameCode: int, played: boolean, gameStatus: string, round: int, roundName: string, localDate: string, utcDate: string, "
    f"isNeutralVenue: boolean, phaseType: {_NAMED}, season: struct<competitionCode: string>, local: {_CLUB}, road: {_CLUB}, "
    f"venue: struct<code: string, name: string, capacity: int>, referee1: {_NAMED}, referee2: {_NAMED}, referee3: {_NAMED}, referee4: {_NAMED}>>"
)
SHOTS = (
    "Rows array<struct<NUM_ANOT: int, COMPETITION_PAGE: int, ID_PLAYER: string, TEAM: string, ID_ACTION: string, ACTION: string, POINTS: int, COORD_X: int, COORD_Y: int, "
    "ZONE: string, FASTBREAK: string, SECOND_CHANCE: string, POINTS_OFF_TURNOVER: string, MINUTE: int, CONSOLE: string, POINTS_A: int, POINTS_B: int>>"
)
GAME = Stream(("season", "game"), "pos")


def _from_path(df: DataFrame) -> DataFrame:
    path = F.col("_metadata.file_path")
    return df.select(
        F.regexp_extract(path, r"/([^/]+)/[^/]+/\d+\.json$", 1).alias("season"),
        F.regexp_extract(path, r"/(\d+)\.json$", 1).cast("int").alias("game"),
        "*",
    )


def payloads(spark: SparkSession, root: str, endpoint: str, schema: str, only: list[tuple[str, int]] | None = None) -> DataFrame:
    """An endpoint's payloads of the whole tree; with `only`, of these (season, game), and no other file is opened."""
    reader = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "[0-9]*.json")
    return _from_path(reader.json(f"{root}/*/{endpoint}" if only is None else [f"{root}/{s}/{endpoint}/{g}.json" for s, g in only]))


def files(spark: SparkSession, root: str) -> DataFrame:
    """Rows (season, endpoint, game, byte_size, path, content): every payload by numeric game; unread unless asked for."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "[0-9]*.json").option("recursiveFileLookup", True).load(root)
    part = lambda i: F.regexp_extract("path", r"/([^/]+)/([^/]+)/(\d+)\.json$", i)
    return found.where(part(3) != "").select(
        part(1).alias("season"), part(2).alias("endpoint"), part(3).cast("int").alias("game"), F.col("length").alias("byte_size"), "path", "content"
    )


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """Rows (season, endpoint, game, sha256, byte_size, path): every payload by numeric game, with its exact hash."""
    return files(spark, root).select("season", "endpoint", "game", F.sha2("content", 256).alias("sha256"), "byte_size", "path")


def _canonical(text: pd.Series) -> pd.Series:
    def one(t: str | None) -> str | None:
        if t is None:
            return None
        plain = json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        return hashlib.sha256(plain.encode()).hexdigest()

    return text.map(one)


def canonical_sha256(text: Column | str) -> Column:
    """SHA-256 of JSON with keys sorted at every level, compact, UTF-8; Spark has no recursive key sort."""
    return F.pandas_udf(_canonical, StringType())(text)


def events(pbp: DataFrame) -> DataFrame:
    """Rows (season, game, pos, source_list, period, playtype, player_id, team, clock, points_a, points_b, number)."""
    rows = pbp.select("season", "game", F.posexplode(F.concat(*[_tagged(p) for p in PERIODS])).alias("pos", "e"))
    rows = rows.select(
        "season", "game", "pos", "e.source_list",
        trimmed(F.col("e.r.PLAYTYPE")).alias("playtype"), trimmed(F.col("e.r.PLAYER_ID")).alias("player_id"),
        trimmed(F.col("e.r.CODETEAM")).alias("team"), trimmed(F.col("e.r.MARKERTIME")).alias("clock"),
        integer_or_null(F.col("e.r.POINTS_A")).alias("points_a"), integer_or_null(F.col("e.r.POINTS_B")).alias("points_b"),
        F.col("e.r.NUMBEROFPLAY").alias("number"), F.col("e.r.MINUTE").alias("minute"),
    )
    # an overtime begins at the first row that isn't the end of the game after an end of a period
    extra = GAME.within("source_list")
    told = F.last(F.when(F.col("playtype") != "EG", F.col("playtype")), ignorenulls=True).over(extra.before)
    begins = (F.col("source_list") == "ExtraTime") & (F.col("playtype") != "EG") & (told == "EP")
    rows = rows.withColumn("_new", F.coalesce(begins, F.lit(False)).cast("int"))
    overtime = F.sum("_new").over(extra.so_far)
    number = F.array_position(F.lit(list(PERIODS)), F.col("source_list")).cast("int")
    return rows.withColumn("period", (number + overtime).cast("int")).drop("_new")


def _tagged(name: str) -> Column:
    empty = F.array().cast(f"array<{_EVENT}>")
    return F.transform(F.coalesce(F.col(name), empty), lambda r: F.struct(F.lit(name).alias("source_list"), r.alias("r")))


def _snake(name: str) -> str:
    return "".join(f"_{c.lower()}" if c.isupper() and i else c.lower() for i, c in enumerate(name))


def _needed(value: Column, what: str) -> Column:
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit(f"{what} is missing")).cast("string"))


def players(box: DataFrame) -> DataFrame:
    """One row per listed player: ids, flags, official minutes and 18 statistics."""
    rows = box.select("season", "game", F.explode("Stats").alias("s")).select("season", "game", F.explode("s.PlayersStats").alias("p"))
    flag = lambda c: strict_boolean(F.regexp_replace(F.coalesce(F.col(c), F.lit("0")), r"\.0$", ""))
    return rows.select(
        "season", "game", _needed(trimmed(F.col("p.Player_ID")), "player id").alias("player_id"), _needed(trimmed(F.col("p.Team")), "team").alias("team"),
        trimmed(F.col("p.Player")).alias("name"), trimmed(F.col("p.Dorsal")).alias("dorsal"), flag("p.IsStarter").alias("is_starter"),
        flag("p.IsPlaying").alias("is_playing"), trimmed(F.col("p.Minutes")).alias("minutes"), F.col("p.Plusminus").alias("plus_minus"),
        *[F.col(f"p.{s}").alias(_snake(s)) for s in STATISTICS],
    )


def team_rows(box: DataFrame) -> DataFrame:
    """Two rows per team: its total, and what no player is credited with."""
    rows = box.select("season", "game", F.explode("Stats").alias("s"))
    code = F.coalesce(trimmed(F.col("s.tmr.Team")), trimmed(F.get(F.col("s.PlayersStats"), F.lit(0))["Team"]))
    kinds = F.array(
        F.struct(F.lit("total").alias("row_kind"), F.col("s.totr").alias("t")), F.struct(F.lit("team_only").alias("row_kind"), F.col("s.tmr").alias("t"))
    )
    rows = rows.select("season", "game", code.alias("team"), trimmed(F.col("s.Coach")).alias("coach"), F.explode(kinds).alias("k"))
    rows = rows.withColumn("team", _needed(F.col("team"), "team code"))
    return rows.select("season", "game", "team", "coach", "k.row_kind", *[F.col(f"k.t.{s}").alias(_snake(s)) for s in STATISTICS])


def games(spark: SparkSession, root: str, season: str) -> DataFrame:
    """The schedule of a season: one row per game, played or not."""
    rows = spark.read.schema(SCHEDULE).option("multiLine", True).json(f"{root}/{season}/schedule.json").select(F.explode("data").alias("g"))
    referees = F.array_compact(F.array(*[F.col(f"g.referee{i}.name") for i in range(1, 5)]))
    codes = F.array_compact(F.array(*[F.col(f"g.referee{i}.code") for i in range(1, 5)]))
    return rows.select(
        F.lit(season).alias("season"), F.col("g.gameCode").alias("game"), F.col("g.played").eqNullSafe(True).alias("played"),
        F.col("g.round").alias("round"), trimmed(F.col("g.phaseType.code")).alias("phase"),
        F.to_timestamp_ntz(F.col("g.localDate")).alias("local_date"), F.to_timestamp("g.utcDate").alias("utc_date"),
        trimmed(F.col("g.local.club.code")).alias("home"), trimmed(F.col("g.road.club.code")).alias("away"),
        trimmed(F.col("g.local.club.name")).alias("home_name"), trimmed(F.col("g.road.club.name")).alias("away_name"),
        F.col("g.local.score").alias("home_score"), F.col("g.road.score").alias("away_score"),
        F.coalesce("g.isNeutralVenue", F.lit(False)).alias("neutral"), trimmed(F.col("g.venue.name")).alias("venue"), referees.alias("referees"),
        codes.alias("referee_codes"), trimmed(F.col("g.gameStatus")).alias("status"), trimmed(F.col("g.roundName")).alias("round_name"),
        trimmed(F.col("g.phaseType.name")).alias("phase_name"), trimmed(F.col("g.season.competitionCode")).alias("competition"),
        trimmed(F.col("g.venue.code")).alias("venue_code"), F.col("g.venue.capacity").alias("venue_capacity"),
    )


def teams(scheduled: DataFrame) -> DataFrame:
    """Rows (season, team, name) of all scheduled games, played or not; of several names the one of the latest game."""
    sides = F.explode(F.array(*[F.struct(F.col(s).alias("team"), F.col(f"{s}_name").alias("name")) for s in ("home", "away")]))
    rows = scheduled.select("season", "game", sides.alias("t")).where("t.team IS NOT NULL")
    return rows.groupBy("season", "t.team").agg(F.max_by("t.name", "game").alias("name"))


def with_box(games: DataFrame, box: DataFrame) -> DataFrame:
    """games with what their box scores tell: attendance, the officials' pairs, and whether the game was still live."""
    own = box.select(
        "season", "game", integer_or_null(trimmed(F.col("Attendance"))).alias("attendance"), referee_pairs(F.col("Referees")).alias("referee_pairs"),
        F.col("Live").alias("live"),
    )
    return games.join(own, ["season", "game"], "left")


def referee_pairs(text: Column) -> Column:
    """'A, B, C, D' as pairs 'A, B' and 'C, D'; an odd number of parts is an error."""
    parts = F.split(text, r"\s*,\s*")
    odd = F.raise_error(F.lit("referees don't come in pairs")).cast("array<string>")
    pairs = F.transform(F.sequence(F.lit(1), F.floor(F.size(parts) / 2).cast("int")), lambda i: F.concat_ws(", ", F.element_at(parts, 2 * i - 1), F.element_at(parts, 2 * i)))
    return F.when(trimmed(text).isNull(), F.array().cast("array<string>")).when(F.size(parts) % 2 == 0, pairs).otherwise(odd)


def shots(points: DataFrame) -> DataFrame:
    """One row per shot; a payload without its list is an error, an empty list gives none."""
    empty = F.raise_error(F.lit("Rows must be a list")).cast("array<struct<NUM_ANOT: int>>")
    checked = points.withColumn("ok", F.when(F.col("Rows").isNull(), F.size(empty)).otherwise(0)).where("ok = 0")
    rows = checked.select("season", "game", F.explode("Rows").alias("s"))
    return rows.select(
        "season", "game", F.col("s.NUM_ANOT").alias("number"), trimmed(F.col("s.ID_PLAYER")).alias("player_id"), trimmed(F.col("s.TEAM")).alias("team"),
        trimmed(F.col("s.ID_ACTION")).alias("action"), F.col("s.POINTS").alias("points"), F.col("s.COORD_X").alias("x"), F.col("s.COORD_Y").alias("y"),
        trimmed(F.col("s.ZONE")).alias("zone"), (F.col("s.FASTBREAK") == "1").alias("fastbreak"), (F.col("s.SECOND_CHANCE") == "1").alias("second_chance"),
        (F.col("s.POINTS_OFF_TURNOVER") == "1").alias("off_turnover"),
    )
