"""Guards of loads: what must hold before anything is written or replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rallyline.operators.quality import Violation, refuse
from rallyline.operators.rosters import KEYS
from rallyline.plans.season import Derived, Season, derive
from rallyline.sources.warehouse import Warehouse


def in_scope(rows: DataFrame, games: DataFrame, what: str) -> None:
    """Refuse rows of other games than those that are loaded."""
    refuse(rows.join(games.select(*KEYS), list(KEYS), "left_anti").select(*KEYS).distinct(), f"{what} of other games")


def one_season(games: DataFrame) -> None:
    seasons = [r[0] for r in games.select("season").distinct().limit(2).collect()]
    if len(seasons) > 1:
        raise Violation(f"seasons are mixed: {', '.join(sorted(map(str, seasons)))}")


def not_derived(spark: SparkSession, games: DataFrame, out: str) -> None:
    """Refuse to replace inputs that derived tables rest on."""
    if (held := Warehouse.opened(spark, out).table("verdicts")) is not None:
        refuse(games.select(*KEYS).join(held.select(*KEYS), list(KEYS), "left_semi"), "derived tables rest on these games")


def empty_target(spark: SparkSession, out: str) -> None:
    """Refuse a full build into a warehouse that holds games already."""
    held = Warehouse.opened(spark, out).table("verdicts")
    if held is not None and not held.isEmpty():
        raise Violation(f"{out} holds games already; build the new ones instead")


def load(season: Season, root: str, derived: str) -> None:
    """Publish a season's flat tables in one step, replacing those games' rows and no others, once all guards hold."""
    games = season.games.select(*KEYS)
    one_season(games)
    not_derived(games.sparkSession, games, derived)
    for name in Season.names():
        if set(KEYS) <= set((rows := getattr(season, name)).columns):
            in_scope(rows, games, name)
    season.save(root)


def build_whole(season: Season, out: str, refused: list[DataFrame] | None = None) -> Derived:
    """A first build of all derived tables."""
    one_season(season.games)
    empty_target(season.games.sparkSession, out)
    made = derive(season, refused)
    made.save(out)
    return made
