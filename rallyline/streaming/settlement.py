"""Settlement checkpoints: when a finished game's payload is owed another look."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Checkpoints after a game's first fetch, in hours.
CHECKPOINTS = (("+6h", 6), ("+24h", 24), ("+72h", 72), ("+7d", 168))


def _checkpoints(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CHECKPOINTS), "label string, hours int")


def due(fetches: DataFrame, now: Column, game: str = "game", at: str = "fetched_at") -> DataFrame:
    """Rows (game, label, hours, first_at): checkpoints passed at `now` that no fetch has reached yet."""
    seen = fetches.groupBy(game).agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"))
    rows = seen.withColumn("c", F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.lit(h).alias("hours")) for x, h in CHECKPOINTS])))
    mark = F.col("first_at") + F.make_dt_interval(hours=F.col("c.hours"))
    return rows.where((now >= mark) & (F.col("last_at") < mark)).select(game, "c.label", "c.hours", "first_at")


def owed(fetches: DataFrame, now: Column, limit: int, game: str = "game", at: str = "fetched_at") -> DataFrame:
    """The oldest owed checkpoint of each game, oldest first fetch first, `limit` games; one reading discharges all."""
    rows = due(fetches, now, game, at)
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy(game).orderBy("hours"))).where("n = 1").drop("n")
    return first.orderBy("first_at", game).limit(limit)


def elapsed_hours(first: Column, now: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(first.cast("timestamp"))) / F.lit(3_600_000_000.0)


def changed_games(fetches: DataFrame, game: str = "game", at: str = "fetched_at", sha: str = "sha256") -> DataFrame:
    """Distinct games, in order, whose payload's checksum ever differed from the one before."""
    order = Window.partitionBy(game).orderBy(at)
    rows = fetches.withColumn("_before", F.lag(sha).over(order))
    return rows.where(F.col("_before").isNotNull() & (F.col("_before") != F.col(sha))).select(game).distinct().orderBy(game)
