"""Queries of the checks that a warehouse rests on: digests that find what differs, identifier widths, clock rules, sums."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyline.functions.scalars import lineup_hash
from rallyline.operators import episodes, ordered, quality, rosters
from rallyline.operators.rosters import GAME
from rallyline.plans import season as plan
from rallyline.queries import _COURTS, _STREAM, USERS, stand_in, table

Query = Callable[[SparkSession, str], DataFrame]


def q_digest_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against a copy in which rows were changed, lost and added: what differs, and how many ranges were read for it."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    key = F.col("o_orderkey")
    copy = orders.where(key % 1009 != 5).withColumn("o_custkey", F.when(key % 997 == 3, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))
    copy = copy.unionByName(orders.where(key % 1013 == 7).withColumn("o_orderkey", -key))
    row = F.to_json(F.struct("o_orderkey", "o_orderstatus", "o_custkey"))
    trees = [quality.digest_levels(df, row, "o_orderkey", bits=4, levels=3) for df in (orders, copy)]
    ranges = quality.differing_ranges(*trees, bits=4)
    found = quality.row_differences(orders, copy, row, "o_orderkey", ranges, bits=4)
    return found.select(F.col("o_orderkey").alias("orderkey"), "finding", F.lit(ranges.count()).cast("long").alias("n_ranges"))


def q_identifier_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' unit hashes: how many stay different if only so many bits are kept."""
    part = table(spark, sf_dir, "part")
    ids = part.select(lineup_hash(F.col("p_brand"), F.array("p_name", "p_type")).alias("id"))
    return quality.distinct_by_width(ids, "id")


def q_clock_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Players whose time on court isn't the official one under three rules for a clock that runs backwards, by game.

    Official is what the running maximum gives in even games, what the clock itself gives in the others.
    """
    s = stand_in(spark, sf_dir)
    at = F.col("pos")
    events = s.events.withColumn("elapsed", at - F.when(at % 9 == 0, 20).otherwise(0))
    events = events.withColumn("shifted", F.col("elapsed") + F.when(at % 7 == 0, 60).otherwise(0))
    events = events.withColumn("clamped", ordered.running_maximum(F.col("elapsed"), GAME))
    moves = rosters.transitions(events, s.players)
    rows = rosters.seconds_by_clock(moves, s.players, s.length, {"raw": "elapsed", "shifted": "shifted", "clamped": "clamped"})
    official = F.when(F.col("game") % 2 == 0, F.col("clamped")).otherwise(F.col("raw"))
    return rows.groupBy("game").agg(*[F.count_if(F.col(n) != official).alias(f"{n}_wrong") for n in ("raw", "shifted", "clamped")])


def q_switch_of_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seasons' switches from sums that batches of games left, against one pass over all of them."""
    key, season = F.col("o_orderkey"), F.concat(F.lit("S"), F.col("o_custkey") % 5)
    raw = (key % 2400).cast("int")
    moved = F.when(key % 11 == 0, 60).otherwise(0)
    rows = table(spark, sf_dir, "orders").select(
        season.alias("season"), F.col("o_custkey").alias("game"), raw.alias("seconds_raw"), (raw + moved).alias("seconds_candidate"),
        (raw + F.when(F.col("o_custkey") % 5 < 3, moved).otherwise(0)).alias("seconds_official"),
    )
    batches = [plan.mismatch_sums(rows.where(F.col("game") % 4 == i)) for i in range(4)]
    kept = batches[0].unionByName(batches[1]).unionByName(batches[2]).unionByName(batches[3])
    odd = quality.differences(kept, plan.mismatch_sums(rows)).groupBy("season").agg(F.count("*").alias("n_odd"))
    totals = kept.groupBy("season").agg(F.sum("raw_wrong").alias("raw_wrong"), F.sum("candidate_wrong").alias("candidate_wrong"), F.count("*").alias("n_games"))
    return totals.join(plan.use_correction(kept), "season").join(odd, "season", "left").fillna(0, ["n_odd"])


def free_throw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as plays with and-ones and fouls that leave the ball with the team."""
    kind, at = F.col("event_type"), F.col("event_id")
    play = F.when(kind == "click", F.when(at % 3 == 0, "FTA").otherwise("FTM")).when(kind == "error", "CM")
    play = play.when(kind == "view", F.when(at % 5 == 0, "CMT").otherwise("RV")).otherwise("2FGM")
    return table(spark, sf_dir, "events").select(
        "user_id", "event_id", play.alias("playtype"), F.when(at % 4 < 2, "H").otherwise("A").alias("team"), F.when(F.col("value") > 10, "p").otherwise("q").alias("player")
    )


def q_trip_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free throws with whether their trip is an and-one, and whether possessions leave it out."""
    made = episodes.trips(free_throw_rows(spark, sf_dir), episodes.Plays(USERS)).where("trip IS NOT NULL")
    return made.select("user_id", "event_id", F.col("trip_size").cast("long"), "and_one", "excluded")


def q_off_possession_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points from free throws that belong to no possession, by game and team."""
    return episodes.off_possession_points(free_throw_rows(spark, sf_dir), episodes.Plays(USERS)).select("user_id", "team", "points")


def queries() -> dict[str, Query]:
    return {name: globals()[name] for name in ORACLES}


_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_TRIPS = f"""
    WITH p AS (
      SELECT user_id, event_id, CASE WHEN event_id % 4 < 2 THEN 'H' ELSE 'A' END AS team, CASE WHEN value > 10 THEN 'p' ELSE 'q' END AS player,
             CASE event_type WHEN 'click' THEN CASE WHEN event_id % 3 = 0 THEN 'FTA' ELSE 'FTM' END WHEN 'error' THEN 'CM'
                             WHEN 'view' THEN CASE WHEN event_id % 5 = 0 THEN 'CMT' ELSE 'RV' END ELSE '2FGM' END AS play FROM events
    ), k AS (SELECT *, play IN ('FTM', 'FTA') AS free FROM p WHERE play <> 'RV'),
    l AS (
      SELECT *, free AND NOT (coalesce(lag(free) OVER ({_STREAM}), false) AND lag(player) OVER ({_STREAM}) = player) AS new,
             last_value(CASE WHEN play IN ('2FGM', 'FTM', 'FTA') THEN event_id END IGNORE NULLS) OVER ({_STREAM} {_BEFORE}) AS ball,
             last_value(CASE WHEN play = 'CMT' THEN event_id END IGNORE NULLS) OVER ({_STREAM} {_BEFORE}) AS foul FROM k
    ), n AS (SELECT *, sum(new::INT) OVER ({_STREAM} ROWS UNBOUNDED PRECEDING) AS trip FROM l),
    f AS (
      SELECT n.*, coalesce(b.play = '2FGM' AND b.team = n.team AND b.player = n.player, false) AS one,
             n.foul IS NOT NULL AND (n.ball IS NULL OR n.foul > n.ball) AS retained
      FROM n LEFT JOIN p b ON b.user_id = n.user_id AND b.event_id = n.ball WHERE n.free
    ), t AS (
      SELECT *, count(*) OVER (PARTITION BY user_id, trip) AS trip_size, first_value(one) OVER (PARTITION BY user_id, trip ORDER BY event_id) AS and_one,
             first_value(one OR retained) OVER (PARTITION BY user_id, trip ORDER BY event_id) AS excluded FROM f
    )"""

ORACLES = {
    "q_digest_descent": """
        WITH a AS (SELECT o_orderkey, o_orderstatus, o_custkey FROM orders),
        b AS (SELECT o_orderkey, o_orderstatus, o_custkey + (o_orderkey % 997 = 3)::INT AS o_custkey FROM orders WHERE o_orderkey % 1009 <> 5
              UNION ALL SELECT -o_orderkey, o_orderstatus, o_custkey FROM orders WHERE o_orderkey % 1013 = 7),
        d AS (
          SELECT coalesce(a.o_orderkey, b.o_orderkey) AS orderkey,
                 CASE WHEN b.o_orderkey IS NULL THEN 'missing' WHEN a.o_orderkey IS NULL THEN 'extra' ELSE 'changed' END AS finding
          FROM a FULL OUTER JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_custkey IS DISTINCT FROM b.o_custkey
        )
        SELECT orderkey, finding, (SELECT count(DISTINCT orderkey >> 4) FROM d) AS n_ranges FROM d""",
    "q_identifier_widths": """
        WITH i AS (SELECT DISTINCT left(sha256(p_brand || chr(0) || array_to_string([p_name, p_type], chr(0))), 32) AS id FROM part),
        w AS (SELECT unnest(range(1, 129)) AS bits),
        c AS (
          SELECT bits, count(DISTINCT left(id, bits // 4) || '.' || ((instr('0123456789abcdef', substr(id, bits // 4 + 1, 1)) - 1) >> (4 - bits % 4))::VARCHAR) AS n
          FROM i, w GROUP BY bits
        )
        SELECT bits::INT AS bits, n AS n_distinct, (SELECT count(*) FROM i) - n AS n_shared FROM c""",
    "q_clock_rules": f"""{_COURTS}, clocks AS (
          SELECT game, event_id, raw, raw + CASE WHEN event_id % 7 = 0 THEN 60 ELSE 0 END AS shifted,
                 max(raw) OVER (PARTITION BY game ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS clamped
          FROM (SELECT game, event_id, event_id - CASE WHEN event_id % 9 = 0 THEN 20 ELSE 0 END AS raw FROM e)
        ), timed AS (
          SELECT t.*, coalesce(raw, 0) AS raw, coalesce(shifted, 0) AS shifted, coalesce(clamped, 0) AS clamped
          FROM turns t LEFT JOIN clocks k ON k.game = t.game AND k.event_id = t.moment
        ), spells AS (
          SELECT *, lead(raw) OVER w AS raw_end, lead(shifted) OVER w AS shifted_end, lead(clamped) OVER w AS clamped_end
          FROM timed WINDOW w AS (PARTITION BY game, team, player_id ORDER BY moment)
        ), sums AS (
          SELECT s.game, team, player_id, sum(coalesce(raw_end, game_length) - raw) AS raw, sum(coalesce(shifted_end, game_length) - shifted) AS shifted,
                 sum(coalesce(clamped_end, game_length) - clamped) AS clamped
          FROM spells s JOIN length l ON l.game = s.game WHERE told GROUP BY s.game, team, player_id
        ), o AS (SELECT *, CASE WHEN game % 2 = 0 THEN clamped ELSE raw END AS official FROM sums)
        SELECT game, count(*) FILTER (raw <> official) AS raw_wrong, count(*) FILTER (shifted <> official) AS shifted_wrong,
               count(*) FILTER (clamped <> official) AS clamped_wrong FROM o GROUP BY game""",
    "q_switch_of_sums": """
        WITH r AS (
          SELECT 'S' || (o_custkey % 5) AS season, o_custkey AS game, o_orderkey % 11 = 0 AS moved, o_custkey % 5 < 3 AS told FROM orders
        ), g AS (
          SELECT season, game, count(*) FILTER (moved AND told) AS raw_wrong, count(*) FILTER (moved AND NOT told) AS candidate_wrong FROM r GROUP BY season, game
        )
        SELECT season, sum(raw_wrong)::BIGINT AS raw_wrong, sum(candidate_wrong)::BIGINT AS candidate_wrong, count(*) AS n_games,
               sum(candidate_wrong) < sum(raw_wrong) AS use_correction, 0::BIGINT AS n_odd FROM g GROUP BY season""",
    "q_trip_context": f"""{_TRIPS} SELECT user_id, event_id, trip_size, and_one, excluded FROM t""",
    "q_off_possession_points": f"""{_TRIPS} SELECT user_id, team, count(*) AS points FROM t WHERE excluded AND NOT and_one AND play = 'FTM' GROUP BY user_id, team""",
}
