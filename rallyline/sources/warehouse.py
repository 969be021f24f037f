"""Tables that are published together: immutable files, and one small manifest that makes all of a commit's rows visible.

A commit writes each table's rows as Parquet in a folder of its own that nobody reads yet, the games that it replaces
beside them, and at last a manifest, a file of one line that is put in place by a rename.  A game's rows in a table
come from the last commit that holds the game for that table; tables without games (dimensions) come whole from the last
commit that wrote them.  So a writer that is lost between two tables changes nothing for any reader, and a game never shows one
table's new rows beside another's old ones.

A reader keeps to the version that it opened, whatever is published meanwhile.  Of two writers that reach for one version
the second takes the next, unless they hold a game or a whole table in common: then it fails, and its caller starts again
from what is there now.
"""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyline.operators.quality import Violation

KEYS = ("season", "game")
MANIFEST = "version long, commit string, whole array<string>"


class Conflict(Violation):
    """Somebody else has published what this writer set out from."""


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at a path, None where there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def put(spark: SparkSession, path: str, text: str, replace: bool = False) -> bool:
    """Write a small file in one step: under another name first, then renamed; False if it is there and isn't replaced."""
    jvm = spark._jvm
    files = jvm.org.apache.hadoop.fs
    target = files.Path(path)
    context = files.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    staged = files.Path(target.getParent(), f".{uuid.uuid4().hex}")
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = system.create(staged, False)
    out.write(bytearray(text.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(files.Options.Rename, int(replace))
    if replace:
        options[0] = jvm.java.lang.Enum.valueOf(jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), "OVERWRITE")
    try:
        context.rename(staged, target, options)
    except Py4JJavaError as error:
        system.delete(staged, False)
        if "FileAlreadyExistsException" in str(error.java_exception.getClass().getName()):
            return False
        raise
    return True


@dataclass(frozen=True)
class Warehouse:
    """The tables at a root as of a version; see opened()."""

    spark: SparkSession
    root: str
    version: int

    @classmethod
    def opened(cls, spark: SparkSession, root: str) -> Warehouse:
        """As of the last manifest, version 0 where there is none."""
        log = cls(spark, root, 0)._log()
        return cls(spark, root, (log.agg(F.max("version")).first()[0] or 0) if log is not None else 0)

    def _log(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(MANIFEST).json(f"{self.root}/manifests")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def log(self, after: int = 0) -> DataFrame:
        """Rows (version, commit, whole) of this version's manifests, or of those after another."""
        log = self._log()
        rows = log if log is not None else self.spark.createDataFrame([], MANIFEST)
        return rows.where(F.col("version").between(after + 1, self.version))

    def _data(self, table: str) -> str:
        return f"{self.root}/data/{table}"

    def _held(self, log: DataFrame) -> DataFrame | None:
        """Rows (commit, season, game, table, version) that the log's commits hold."""
        held = existing(self.spark, self._data("published"))
        return None if held is None else held.join(log.select("commit", "version"), "commit").withColumn("table", F.explode("tables")).drop("tables")

    def games(self, table: str) -> DataFrame | None:
        """Rows (season, game, commit): where each game's rows of a table are."""
        held = self._held(self.log())
        return None if held is None else held.where(F.col("table") == table).groupBy(*KEYS).agg(F.max_by("commit", "version").alias("commit"))

    def table(self, name: str) -> DataFrame | None:
        """A table's rows, None where nothing has been published of it."""
        last = self.log().where(F.array_contains("whole", name)).agg(F.max_by("commit", "version")).first()[0]
        if last:
            return self.spark.read.parquet(f"{self._data(name)}/commit={last}")
        rows, games = existing(self.spark, self._data(name)), self.games(name)
        # a whole table that no manifest names yet has no keys
        if rows is None or games is None or not set(KEYS) <= set(rows.columns):
            return None
        return rows.join(games, [*KEYS, "commit"], "left_semi").drop("commit")

    def publish(self, tables: dict[str, DataFrame], games: DataFrame, checked: Callable[[], None] = lambda: None) -> Warehouse:
        """Publish tables in one step; the warehouse as it is then.

        games (season, game) are replaced in each of the tables, also in one that has no row of a game; with a column
        `tables`, an array of names, only in those.  A table that lacks either key is replaced whole.  Whatever isn't named
        stays as it is.  checked() is called when all is written, before anyone can see it; if it raises, nothing happens.
        """
        commit = f"c{uuid.uuid4().hex}"
        whole = sorted(name for name, df in tables.items() if not set(KEYS) <= set(df.columns))
        of = F.col("tables") if "tables" in games.columns else F.lit([name for name in tables if name not in whole]).cast("array<string>")
        for name, df in tables.items():
            rows = df if name in whole else df.sortWithinPartitions(*KEYS)
            rows.write.parquet(f"{self._data(name)}/commit={commit}")
        held = games.select(F.col("season").cast("string").alias("season"), F.col("game").cast("int").alias("game"), of.alias("tables")).distinct()
        held.write.parquet(f"{self._data('published')}/commit={commit}")
        checked()
        version = self.version + 1
        while not put(self.spark, f"{self.root}/manifests/{version:012d}.json", json.dumps({"version": version, "commit": commit, "whole": whole})):
            self._no_conflict(commit, whole, version)
            version += 1
        return Warehouse(self.spark, self.root, version)

    def _no_conflict(self, commit: str, whole: list[str], version: int) -> None:
        """Raise unless what was published since this version was opened leaves alone what the commit holds."""
        since = Warehouse(self.spark, self.root, version).log(after=self.version)
        if whole and (both := since.where(F.arrays_overlap("whole", F.lit(whole))).limit(1).collect()):
            raise Conflict(f"version {both[0]['version']} has replaced {', '.join(sorted({*both[0]['whole']} & {*whole}))}")
        own = self.spark.read.parquet(f"{self._data('published')}/commit={commit}").withColumn("table", F.explode("tables"))
        if both := self._held(since).join(own, [*KEYS, "table"], "left_semi").limit(1).collect():
            raise Conflict(f"version {both[0]['version']} has replaced game {both[0]['game']} of {both[0]['season']}")

    def compacted(self, *names: str) -> Warehouse:
        """Publish tables by game anew as they are, each in one folder, where many small commits have scattered them."""
        held = [self.games(name).select(*KEYS, F.lit(name).alias("name")) for name in names]
        games = functools.reduce(DataFrame.unionByName, held).groupBy(*KEYS).agg(F.collect_set("name").alias("tables"))
        return self.publish({name: self.table(name) for name in names}, games)

    def unreachable(self) -> DataFrame:
        """Rows (table, commit): folders of which no row shows at this version: of lost writers, or since replaced.

        A folder of a writer that is still at work is among them, so whoever deletes them must know that there is none.
        """
        used = self.log().select("commit", F.explode("whole").alias("table"), "version").groupBy("table").agg(F.max_by("commit", "version").alias("commit")).select("commit")
        if (held := self._held(self.log())) is not None:
            used = used.unionByName(held.groupBy(*KEYS, "table").agg(F.max_by("commit", "version").alias("commit")).select("commit"))
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(f"{self.root}/data").select("path")
        part = lambda i: F.regexp_extract("path", r"/data/([^/]+)/commit=([^/]+)/", i)
        return found.select(part(1).alias("table"), part(2).alias("commit")).distinct().join(used.distinct(), "commit", "left_anti").select("table", "commit")
