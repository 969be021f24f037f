"""Commits of several tables: all of one is seen, or nothing."""

import pytest
from pyspark.sql import DataFrameWriter

from rallyline.operators.quality import Violation
from rallyline.sources import warehouse
from rallyline.sources.warehouse import Conflict, Warehouse

EVENTS, PLAYERS = "season string, game int, pos int, what string", "season string, game int, player string"


def tables(spark, games, what, names=("Ann",)):
    events = [("S1", g, p, what) for g in games for p in range(3)]
    people = [("S1", g, f"{what}{i}") for g in games for i in range(2)]
    return {
        "events": spark.createDataFrame(events, EVENTS),
        "players": spark.createDataFrame(people, PLAYERS),
        "names": spark.createDataFrame([(n,) for n in names], "name string"),
    }


def keys(spark, games):
    return spark.createDataFrame([("S1", g) for g in games], "season string, game int")


def seen(spark, root):
    house = Warehouse.opened(spark, root)
    rows = {name: house.table(name) for name in ("events", "players", "names")}
    return {name: None if df is None else sorted(tuple(r) for r in df.collect()) for name, df in rows.items()}


def expected(made):
    return {name: sorted(tuple(r) for r in df.collect()) for name, df in made.items()}


def test_a_game_comes_whole_from_its_last_commit(spark, tmp_path):
    root = str(tmp_path)
    house = Warehouse.opened(spark, root)
    assert house.version == 0 and seen(spark, root) == {"events": None, "players": None, "names": None}
    first = tables(spark, [1, 2], "a")
    house = house.publish(first, keys(spark, [1, 2]))
    assert house.version == 1 and seen(spark, root) == expected(first)
    second = tables(spark, [2], "b", ("Ann", "Bob"))
    second["players"] = second["players"].where("false")  # the game's players are gone
    house.publish(second, keys(spark, [2]))
    got, old, new = seen(spark, root), expected(first), expected(second)
    assert got["events"] == sorted([r for r in old["events"] if r[1] == 1] + new["events"])
    assert got["players"] == [r for r in old["players"] if r[1] == 1] and got["names"] == new["names"]
    # a reader keeps to its version
    assert sorted(tuple(r) for r in house.table("events").collect()) == old["events"] and house.table("names").count() == 1


def test_a_writer_lost_between_two_tables_changes_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    first = tables(spark, [1, 2], "a")
    house = Warehouse.opened(spark, root).publish(first, keys(spark, [1, 2]))
    before = seen(spark, root)
    real, left = DataFrameWriter.parquet, [0]

    def fails(self, path, *args, **more):
        if left[0] == 0:
            raise OSError("lost")
        left[0] -= 1
        return real(self, path, *args, **more)

    monkeypatch.setattr(DataFrameWriter, "parquet", fails)
    for tables_written in range(4):  # none, one, two, three tables, but not the games
        left[0] = tables_written
        with pytest.raises(OSError, match="lost"):
            house.publish(tables(spark, [2, 3], "b", ("Bob",)), keys(spark, [2, 3]))
    monkeypatch.undo()
    monkeypatch.setattr(warehouse, "put", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):  # all tables, but not the manifest
        house.publish(tables(spark, [2, 3], "b", ("Bob",)), keys(spark, [2, 3]))
    monkeypatch.undo()
    assert seen(spark, root) == before and Warehouse.opened(spark, root).version == 1
    lost = Warehouse.opened(spark, root).unreachable().collect()
    assert {r["table"] for r in lost} == {"events", "players", "names", "published"} and len({r["commit"] for r in lost}) == 4
    # and the writer that comes back gets through
    house.publish(made := tables(spark, [2, 3], "b", ("Bob",)), keys(spark, [2, 3]))
    assert seen(spark, root)["names"] == [("Bob",)] and len(seen(spark, root)["events"]) == 9
    assert set(expected(made)["events"]) < set(seen(spark, root)["events"])


def test_two_writers(spark, tmp_path):
    """From one version: another game's commit is the next version, the same game's or table's is refused."""
    root = str(tmp_path)
    start = Warehouse.opened(spark, root)
    games = lambda made: {name: df for name, df in made.items() if name != "names"}
    start.publish(games(tables(spark, [1], "a")), keys(spark, [1]))
    assert start.publish(games(tables(spark, [2], "b")), keys(spark, [2])).version == 2
    with pytest.raises(Conflict, match="game 1 of S1"):
        start.publish(games(tables(spark, [1], "c")), keys(spark, [1]))
    now = Warehouse.opened(spark, root)
    now.publish(tables(spark, [3], "d"), keys(spark, [3]))
    with pytest.raises(Conflict, match="names"):
        now.publish(tables(spark, [4], "e"), keys(spark, [4]))
    assert {r[3] for r in seen(spark, root)["events"]} == {"a", "b", "d"}
    none = {name: df.where("false") for name, df in games(tables(spark, [1], "f")).items()}
    assert Warehouse.opened(spark, root).publish(none, keys(spark, [1])).version == 4  # a game is taken out
    assert {r[3] for r in seen(spark, root)["events"]} == {"b", "d"}


def test_some_tables_of_some_games(spark, tmp_path):
    """One commit may bring a whole new game and one table of an old one; what it doesn't name stays."""
    root = str(tmp_path)
    house = Warehouse.opened(spark, root).publish(tables(spark, [1, 2], "a"), keys(spark, [1, 2]))
    made = {name: df for name, df in tables(spark, [1, 3], "b").items() if name != "names"}
    made["events"] = made["events"].where("game = 3")
    games = spark.createDataFrame([("S1", 1, ["players"]), ("S1", 3, ["events", "players"])], "season string, game int, tables array<string>")
    house.publish(made, games)
    got = seen(spark, root)
    assert {(r[1], r[3]) for r in got["events"]} == {(1, "a"), (2, "a"), (3, "b")} and got["names"] == [("Ann",)]
    assert {(r[1], r[2][0]) for r in got["players"]} == {(1, "b"), (2, "a"), (3, "b")}


def test_a_failed_check_publishes_nothing(spark, tmp_path):
    house = Warehouse.opened(spark, str(tmp_path))

    def checked():
        raise Violation("rows were lost")

    with pytest.raises(Violation, match="rows were lost"):
        house.publish(tables(spark, [1], "a"), keys(spark, [1]), checked)
    assert Warehouse.opened(spark, str(tmp_path)).version == 0


def test_put_is_one_step(spark, tmp_path):
    path = str(tmp_path / "pointer")
    assert warehouse.put(spark, path, "one") and not warehouse.put(spark, path, "two")
    assert (tmp_path / "pointer").read_text() == "one"
    assert warehouse.put(spark, path, "two", replace=True) and (tmp_path / "pointer").read_text() == "two"
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["pointer"]
