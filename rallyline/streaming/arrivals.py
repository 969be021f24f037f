"""A game's payloads meet in state: it is ready when the last of them and the schedule's word that it was played are in.

Arrivals are rows (season, game, what, played, at), what being an endpoint or SCHEDULE; a schedule that is fetched again
is an arrival again, so a game whose row turns to played late becomes ready without another payload.  Settlement marks are
timers of the event time: each of them fires once the stream's clock has passed it.

What is told depends on the arrivals' own times, not on how they are cut into batches, so a replay gives the same rows; only
a first arrival that comes in a later batch than a second one of the same kind is told by the second's time.  The state of
a game is a few words, kept by key in the state store, which must be STATE_STORE's.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from rallyline.streaming import live
from rallyline.streaming.settlement import CHECKPOINTS

SCHEDULE = "schedule"
NEEDED = (*live.ENDPOINTS, SCHEDULE)
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Arrivals(StatefulProcessor):
    """Tells `ready` once for each game, at the time of the last thing it needed, then `due` at each settlement mark."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # the first time at which each needed thing was there, in the order of NEEDED; 0 for none
        self.first = handle.getValueState("first", "times array<long>, told boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        times, told = ([0] * len(NEEDED), False) if not self.first.exists() else (list(self.first.get()[0]), self.first.get()[1])
        for r in rows:
            if r["what"] in NEEDED and (r["what"] != SCHEDULE or r["played"]):
                i, at = NEEDED.index(r["what"]), r["millis"]
                times[i] = min(times[i], at) if times[i] else at
        ready = max(times) if all(times) else None
        self.first.update((times, told or ready is not None))
        if ready is not None and not told:
            for _, hours in CHECKPOINTS:
                self.handle.registerTimer(ready + hours * 3_600_000)
            yield Row(season=key[0], game=key[1], event="ready", millis=ready, hours=0)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        ready, mark = max(self.first.get()[0]), expiredTimerInfo.getExpiryTimeInMs()
        yield Row(season=key[0], game=key[1], event="due", millis=mark, hours=round((mark - ready) / 3_600_000))

    def close(self) -> None:
        pass


def told(arrived: DataFrame, late: str = "1 hour") -> DataFrame:
    """Rows (season, game, event, at, hours) from a stream of arrivals: `ready` games, and marks that are `due`."""
    rows = arrived.withWatermark("at", late).select("season", "game", "what", "played", F.unix_millis("at").alias("millis"), "at")
    shape = "season string, game int, event string, millis long, hours int"
    made = rows.groupBy("season", "game").transformWithState(Arrivals(), shape, "Append", "eventTime")
    return made.select("season", "game", "event", F.timestamp_millis("millis").alias("at"), "hours")


def build_when_ready(spark: SparkSession, arrived: DataFrame, root: str, out: str, checkpoint: str) -> StreamingQuery:
    """Build the seasons of games that become ready, and list what is due in <out>/due; ends when nothing is left to read."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        for row in batch.where("event = 'ready'").select("season").distinct().collect():  # one for each season
            live.build(batch.sparkSession, root, row["season"], out)
        # by batch, so that a batch that is run again replaces what it wrote
        batch.where("event = 'due'").write.mode("overwrite").parquet(f"{out}/due/batch={number}")
        batch.unpersist()

    writer = told(arrived).writeStream.foreachBatch(each).outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
