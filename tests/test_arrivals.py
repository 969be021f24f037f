"""Games become ready when all they need has come, in any order and any batches."""

import json
import random

import pytest

from league import GAMES, write_season
from rallyline.sources.warehouse import Warehouse
from rallyline.streaming import arrivals

SHAPE = "season string, game int, what string, played boolean, at timestamp"


def row(game, what, hour, played=None):
    return {"season": "S1", "game": game, "what": what, "played": played, "at": f"2024-10-{1 + hour // 24:02d}T{hour % 24:02d}:00:00Z"}


ROWS = [
    *[row(1, e, h) for h, e in enumerate(("PlaybyPlay", "Boxscore", "Points"))], row(1, "schedule", 3, True), row(1, "Points", 9),
    *[row(2, e, 2) for e in ("PlaybyPlay", "Boxscore", "Points")], row(2, "schedule", 1, False), row(2, "schedule", 30, True),
    *[row(3, e, 4) for e in ("PlaybyPlay", "Boxscore")], row(3, "schedule", 4, True),
    row(4, "schedule", 5, True), row(4, "other", 5),
]
LAST = [row(9, "other", 60)]


@pytest.fixture(autouse=True)
def state_store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, arrivals.STATE_STORE)
    yield
    spark.conf.unset(name)


def run(spark, folder, batches):
    """What is told when the batches come one file after another; each run of the stream goes on from the last."""
    found = []
    source, state = folder / "in", folder / "state"
    source.mkdir(parents=True)
    for n, rows in enumerate(batches):
        (source / f"{n}.json").write_text("\n".join(map(json.dumps, rows)))
        stream = spark.readStream.schema(SHAPE).json(str(source))
        query = arrivals.told(stream).writeStream.foreachBatch(lambda df, _: found.extend(df.selectExpr("game", "event", "date_format(at, 'dd HH') AS at", "hours").collect())).outputMode("append")
        query.option("checkpointLocation", str(state)).trigger(availableNow=True).start().awaitTermination()
    return sorted((r["game"], r["event"], r["at"], r["hours"]) for r in found)


def test_ready_and_due_whatever_the_order(spark, tmp_path):
    """Game 2 turns to played 28 hours after its payloads; games 3 and 4 lack some; marks that the clock has passed are due."""
    expected = sorted([
        (1, "ready", "01 03", 0), (1, "due", "01 09", 6), (1, "due", "02 03", 24), (2, "ready", "02 06", 0), (2, "due", "02 12", 6), (2, "due", "03 06", 24),
    ])
    assert run(spark, tmp_path / "a", [ROWS, LAST]) == expected
    mixed = [r for r in ROWS if r["at"] < "2024-10-02"]
    random.Random(2).shuffle(mixed)
    late = [r for r in ROWS if r["at"] >= "2024-10-02"]
    assert run(spark, tmp_path / "b", [mixed, late, LAST]) == expected


def test_a_ready_game_is_built(spark, tmp_path):
    """Game 4's schedule row says that it was played after all payloads are there: it is built then, by no new payload."""
    raw, out, source = tmp_path / "raw", str(tmp_path / "out"), tmp_path / "in"
    write_season(raw)
    source.mkdir()
    schedule = raw / "S1" / "schedule.json"
    body = json.loads(schedule.read_text())
    later = json.dumps(body)
    next(g for g in body["data"] if g["gameCode"] == 4)["played"] = False
    schedule.write_text(json.dumps(body))

    def run(name, rows):
        (source / name).write_text("\n".join(map(json.dumps, rows)))
        stream = spark.readStream.schema(SHAPE).json(str(source))
        arrivals.build_when_ready(spark, stream, str(raw), out, str(tmp_path / "state")).awaitTermination()
        return {r["game"] for r in Warehouse.opened(spark, out).table("verdicts").collect()}

    first = [row(g, what, 1, what == "schedule" and g < 4) for g in GAMES for what in arrivals.NEEDED]
    assert run("1.json", first) == {1, 2, 3}
    schedule.write_text(later)
    assert run("2.json", [row(4, "schedule", 30, True)]) == {1, 2, 3, 4}
    assert spark.read.parquet(f"{out}/due").select("game", "hours").distinct().count() == 6
