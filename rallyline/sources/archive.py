"""An archive of payloads: bodies by content hash, a versioned index from fetch observations, and guards.

Bodies are an append-only Parquet table by hash, so a body is never overwritten and equal bodies are kept once.  The
index holds, for each response and body, when it was seen first and last.  These merge, so new observations change the
index rows of their own games and no others; `versions` over all observations gives the same.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rallyline.operators.quality import count_differences, refuse
from rallyline.session import durable
from rallyline.sources import payloads
from rallyline.sources.warehouse import Warehouse, existing, put

#: What names a response.
RESPONSE = ("season", "endpoint", "game")


def objects(spark: SparkSession, root: str) -> DataFrame:
    """Rows (season, endpoint, game, sha256, byte_size, object_path, content) of a payload tree."""
    sha = F.sha2("content", 256)
    name = F.concat_ws("/", "season", "endpoint", F.concat(sha, F.lit(".json.gz")))
    return payloads.files(spark, root).select(*RESPONSE, sha.alias("sha256"), "byte_size", name.alias("object_path"), "content")


def store(made: DataFrame, path: str) -> None:
    """Append the bodies whose hash the archive doesn't hold yet; a second run adds nothing."""
    bodies = made.select("sha256", "byte_size", "content").dropDuplicates(["sha256"])
    if (held := existing(made.sparkSession, path)) is not None:
        bodies = bodies.join(held.select("sha256"), "sha256", "left_anti")
    # written first: the plan above reads the table that is appended to
    durable(bodies).write.mode("append").option("compression", "gzip").parquet(path)


def damaged(bodies: DataFrame) -> DataFrame:
    """Violations: stored bodies that don't have the hash or the size of their entry."""
    return bodies.where((F.sha2("content", 256) != F.col("sha256")) | (F.length("content") != F.col("byte_size"))).select("sha256")


def archive_season(spark: SparkSession, root: str, season: str, path: str, sample: int = 16) -> DataFrame:
    """Store a season's bodies, then read some of them back and verify them; the season's objects.

    One in `sample` is read back, by hash, and of each endpoint the one with the least hash in any case.  A body that is
    missing or damaged ends the run.
    """
    made = objects(spark, root).where(F.col("season") == season)
    store(made, path)
    first = made.groupBy("endpoint").agg(F.min("sha256").alias("sha256")).select("sha256")
    picked = made.select("sha256").where(F.pmod(F.xxhash64("sha256"), F.lit(sample)) == 0).unionByName(first).distinct()
    held = spark.read.parquet(path)
    refuse(picked.join(held, "sha256", "left_anti"), "bodies weren't stored")
    refuse(damaged(held.join(picked, "sha256", "left_semi")), "stored bodies are damaged")
    return made.drop("content")


def restored_season(spark: SparkSession, out: str, season: str) -> DataFrame | None:
    """Rows (endpoint, game, sha256, byte_size, content) that restore_season put in place last, None where none were."""
    if (pointer := _pointer(spark, out, season)) is None:
        return None
    return spark.read.parquet(f"{out}/{season}/{pointer}")


def _pointer(spark: SparkSession, out: str, season: str) -> str | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{season}/current")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.text(f"{out}/{season}/current").first()[0]


def restore_season(index: DataFrame, bodies: DataFrame, games: DataFrame, season: str, out: str, endpoints: tuple[str, ...]) -> None:
    """Restore a season's current bodies to a folder of their own in <out>/<season>, then point to it, see restored_season.

    The pointer is replaced last and in one step, so at any time a reader finds one restored season whole: a season that
    isn't whole, a body that hasn't its hash, or a run that breaks off leaves what was there before.  The folder that was
    current is deleted after that.
    """
    spark, name = bodies.sparkSession, f"restored-{uuid.uuid4().hex}"
    wanted = index.where(F.col("current") & (F.col("season") == season)).select("endpoint", "game", "sha256")
    wanted.join(bodies.select("sha256", "byte_size", "content"), "sha256").write.parquet(f"{out}/{season}/{name}")
    staged = spark.read.parquet(f"{out}/{season}/{name}")
    refuse(damaged(staged), "bodies are damaged")
    listing = staged.select(F.lit(season).alias("season"), "endpoint", "game")
    refuse(incomplete(games.where(F.col("season") == season), listing, endpoints), "the season isn't whole")
    before = _pointer(spark, out, season)
    put(spark, f"{out}/{season}/current", name, replace=True)
    if before:
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{season}/{before}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def observed(old: DataFrame, new: DataFrame, every_observation: bool = False) -> DataFrame:
    """Fetch observations put together; unless every one counts, one is kept for each response, time and success."""
    both = old.unionByName(new)
    if every_observation:
        return both
    good = both.where("http_status = 200").dropDuplicates([*RESPONSE, "fetched_at"])
    return good.unionByName(both.where("NOT http_status <=> 200"))


def _numbered(rows: DataFrame) -> DataFrame:
    """The bodies of each response with version, in the order in which they were seen first, and current, seen last."""
    of = Window.partitionBy(*RESPONSE)
    number = F.row_number().over(of.orderBy("first_at", "sha256"))
    latest = F.row_number().over(of.orderBy(F.desc("last_at"), F.desc("sha256"))) == 1
    return rows.withColumn("version", number).withColumn("current", latest)


def versions(observations: DataFrame) -> DataFrame:
    """Rows (response, sha256, version, first_at, last_at, current): a body that comes back is current again."""
    good = observations.where("http_status = 200")
    return _numbered(good.groupBy(*RESPONSE, "sha256").agg(F.min("fetched_at").alias("first_at"), F.max("fetched_at").alias("last_at")))


def indexed(house: Warehouse, observations: DataFrame) -> Warehouse:
    """The index (the warehouse's table `index`) with more observations merged into the rows of their games."""
    new = observations.where("http_status = 200").select(*RESPONSE, "sha256", F.col("fetched_at").alias("first_at"), F.col("fetched_at").alias("last_at"))
    games = durable(new.select("season", "game").distinct())
    if (old := house.table("index")) is not None:
        touched = old.join(games, ["season", "game"], "left_semi")
        new = new.unionByName(touched.select(new.columns))
    merged = new.groupBy(*RESPONSE, "sha256").agg(F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))
    return house.publish({"index": _numbered(merged)}, games)


def metadata_differences(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (response, finding) where two listings of responses differ: missing in b, extra in b, or changed in a column.

    Nulls are values here: a column that one side lacks a value of differs.
    """
    left = a.select(*RESPONSE, F.struct(*columns).alias("a"))
    right = b.select(*RESPONSE, F.struct(*columns).alias("b"))
    both = left.join(right, list(RESPONSE), "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    return both.select(*RESPONSE, F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("changed").alias("finding"))


def content_changes(observations: DataFrame) -> DataFrame:
    """The observations with `content_changed`: there is an earlier body, and it differs."""
    before = F.lag("sha256").over(Window.partitionBy(*RESPONSE).orderBy("fetched_at"))
    changed = before.isNotNull() & (before != F.col("sha256"))
    return observations.where("http_status = 200").withColumn("content_changed", changed)


def incomplete(games: DataFrame, listing: DataFrame, endpoints: tuple[str, ...]) -> DataFrame:
    """Violations (season, endpoint, game, expected, actual, finding): each played game needs one payload an endpoint."""
    wanted = games.where("played").select("season", F.explode(F.lit(list(endpoints))).alias("endpoint"), "game").distinct()
    repeated = games.where("played").groupBy("season", "game").agg(F.count("*").alias("actual")).where("actual > 1")
    twice = repeated.select(
        "season", F.lit("schedule").alias("endpoint"), "game", F.lit(1).cast("long").alias("expected"), "actual", F.lit("repeated").alias("finding")
    )
    return count_differences(wanted, listing.where(F.col("endpoint").isin(*endpoints)), list(RESPONSE)).unionByName(twice)


def restored(index: DataFrame, bodies: DataFrame, endpoint: str, schema: str) -> DataFrame:
    """The current payloads of an endpoint as rows, from the archive alone: what `payloads.payloads` reads from files.

    A body that doesn't have its hash is an error.
    """
    wanted = index.where(F.col("current") & (F.col("endpoint") == endpoint)).select("season", "game", "sha256")
    rows = wanted.join(bodies.select("sha256", "content"), "sha256", "left")
    sound = F.coalesce(F.sha2("content", 256) == F.col("sha256"), F.lit(False))
    text = F.when(sound, F.decode("content", "UTF-8")).otherwise(F.raise_error(F.concat(F.lit("no sound body for "), "sha256")).cast("string"))
    return rows.select("season", "game", F.from_json(text, schema, {"mode": "FAILFAST"}).alias("r")).select("season", "game", "r.*")
