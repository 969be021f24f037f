"""New games as they arrive: a stream of payload files starts builds, and each build is a no-op for what is there.

A build opens the payloads of the games that the warehouse lacks and no others.  A season's correction switch depends on
all its games, but it is a sum of sums that are kept for each game; where new games turn it, the minutes and verdicts of the
season's older games are made again from what is stored.  All of a build is published in one commit, so one that an
executor or the driver loses is simply run again.
"""

from __future__ import annotations

import functools
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rallyline.operators.quality import refuse
from rallyline.operators.rosters import KEYS
from rallyline.plans.season import Derived, Season, derive, flipped, use_correction
from rallyline.session import durable
from rallyline.sources import payloads
from rallyline.sources.warehouse import Warehouse

#: The payloads that a game needs.
ENDPOINTS = ("PlaybyPlay", "Boxscore", "Points")


def complete_games(spark: SparkSession, root: str, season: str) -> DataFrame:
    """Rows (season, game): played games of a season with all their payloads; only file names are read."""
    there = payloads.files(spark, root).where(F.col("endpoint").isin(*ENDPOINTS) & (F.col("season") == season))
    whole = there.groupBy(*KEYS).agg(F.count_distinct("endpoint").alias("n")).where(F.col("n") == len(ENDPOINTS))
    return payloads.games(spark, root, season).where("played").select(*KEYS).join(whole, list(KEYS), "left_semi")


def new_games(candidates: DataFrame, house: Warehouse) -> DataFrame:
    """The candidates (season, game) without a verdict in the warehouse."""
    verdicts = house.table("verdicts")
    return candidates if verdicts is None else candidates.join(verdicts.select(*KEYS), list(KEYS), "left_anti")


def upserted(old: DataFrame | None, new: DataFrame, keys: list[str], newer: str | None = None) -> DataFrame:
    """The rows of both tables by key, the new table's where both have it, or the one that is greater in `newer`."""
    if old is None:
        return new
    old = old.select([F.col(c).cast(t) for c, t in new.dtypes])
    if newer is None:
        return old.join(new, keys, "left_anti").unionByName(new)
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = Window.partitionBy(*keys).orderBy(F.desc(newer), F.desc("_new"))
    return rows.withColumn("_nth", F.row_number().over(last)).where("_nth = 1").select(new.columns)


def missing(spark: SparkSession, root: str, season: str) -> DataFrame:
    """Rows (season, game, endpoint): the payloads that played games of a season lack; only file names are read."""
    wanted = payloads.games(spark, root, season).where("played").select(*KEYS, F.explode(F.lit(list(ENDPOINTS))).alias("endpoint"))
    there = payloads.files(spark, root).select(*KEYS, "endpoint")
    return wanted.join(there, [*KEYS, "endpoint"], "left_anti")


def build(spark: SparkSession, root: str, season: str, out: str, partial: bool = True) -> DataFrame:
    """Derive and publish the games that the warehouse lacks; their keys.

    Games without all their payloads wait for a later build; with partial off, any of them ends the build before
    anything is written, all named.  Games that break a rule go to the table `refused` with their findings, until a later
    build, which tries them again, finds them sound.
    """
    if not partial:
        refuse(missing(spark, root, season), "payloads are missing")
    house = Warehouse.opened(spark, out)
    fresh = durable(new_games(complete_games(spark, root, season), house))
    only = sorted(r["game"] for r in fresh.collect())  # names of files of one season
    if not only:
        return fresh
    old = stored_season(house, season)
    refused: list[DataFrame] = []
    made = derive(Season.read(spark, root, season, only), refused, old and old.sums, house.table("lineups"))
    bad = durable(functools.reduce(DataFrame.unionByName, refused))
    turned_away = bad.select(*KEYS).distinct()
    fresh = durable(fresh.join(turned_away, list(KEYS), "left_anti").select(*KEYS))
    kept = {name: upserted(house.table(name), getattr(made, name), keys, newer) for name, keys, newer in DIMENSIONS}
    held = lambda games, names: games.select(*KEYS, F.lit(list(names)).alias("tables"))
    games = held(fresh, [*Derived.names(), "refused"]).unionByName(held(turned_away, ["refused"]))
    if old is not None and (switch := turned(old, made)) is not None:
        minutes, verdicts = flipped(old, switch)
        kept |= {"minutes": made.minutes.unionByName(minutes.select(made.minutes.columns)), "verdicts": made.verdicts.unionByName(verdicts.select(made.verdicts.columns))}
        games = games.unionByName(held(old.verdicts, ["minutes", "verdicts"]))
    replace(made, **kept).save(out, house, {"refused": bad}, games)
    return fresh


#: Tables that a build adds to: their keys, and what tells the newer of two rows.
DIMENSIONS = (
    ("dimension_players", ["player_id"], "name_season"), ("dimension_teams", ["season", "team"], None),
    ("lineups", ["lineup_id"], None), ("lineup_players", ["lineup_id", "player_id"], None),
)


def stored_season(house: Warehouse, season: str) -> Derived | None:
    """The season's derived tables as they are stored, None where it has no game yet."""
    tables = {name: house.table(name) for name in Derived.names()}
    if tables["verdicts"] is None or (own := tables["verdicts"].where(F.col("season") == season)).isEmpty():
        return None
    return Derived(**tables | {name: tables[name].where(F.col("season") == season) for name in ("minutes", "sums")} | {"verdicts": own})


def turned(old: Derived, made: Derived) -> DataFrame | None:
    """The season's switch (season, use_correction) if the new games turn it, else None."""
    was = use_correction(old.sums).first()
    now = use_correction(old.sums.unionByName(made.sums))
    return now if now.first()["use_correction"] != was["use_correction"] else None


def follow(spark: SparkSession, root: str, out: str, checkpoint: str) -> StreamingQuery:
    """Build the seasons of all files that have come since the last run, then end; a second run finds nothing to do.

    A game whose schedule row turns to played after its files came is built by the season's next file or call of build.
    """
    arrived = spark.readStream.option("wholetext", True).option("pathGlobFilter", "[0-9]*.json").text(f"{root}/*/*")
    seasons = arrived.select(F.regexp_extract("_metadata.file_path", r"/([^/]+)/[^/]+/\d+\.json$", 1).alias("season"))

    def each(batch: DataFrame, _: int) -> None:
        for row in batch.distinct().collect():  # one row for each season
            build(batch.sparkSession, root, row["season"], out)

    return seasons.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
